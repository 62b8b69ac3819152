import random

import numpy as np
import pyarrow as pa
import pytest

from sigloom.llm import near_dedup as nd

WORDS = [f"{a}{b}" for a in "ba de ki lo mu na pe ri so tu va ze".split() for b in "n r st l m ck".split()]


def corpus(seed=0, base=30):
    """Random texts, with exact, edited and chained copies; some empty, null and very short."""
    r = random.Random(seed)
    docs = []
    for _ in range(base):
        w = [r.choice(WORDS) + r.choice(WORDS) for _ in range(r.randint(20, 120))]
        docs.append(" ".join(w))
        for _ in range(r.randint(0, 4)):
            v = [x if r.random() > 0.04 else r.choice(WORDS) for x in w]
            docs.append(" ".join(v))
            if r.random() < 0.5:
                w = v
    docs += [docs[0]] * 25 + ["", None, "one", "one", "One!", "two words", "x " * 3000]
    r.shuffle(docs)
    return [(i, t, "en", "s", 1) for i, t in enumerate(docs)]


def brute(rows):
    """Components of all pairs within the distance, from all pairs."""
    ids, texts = zip(*[(i, t) for i, t, *_ in rows if i is not None and t is not None])
    keep, sig = nd.signature_matrix(pa.array(texts, pa.string()))
    ids = np.array(ids)[keep]
    root = {i: i for i in ids.tolist()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k in range(len(ids)):
        for j in np.flatnonzero((sig[k + 1 :] != sig[k]).sum(axis=1) <= nd.MAX_DIST) + k + 1:
            a, b = sorted((find(ids[k].item()), find(ids[j].item())))
            root[b] = a
    groups = {}
    for i in root:
        groups.setdefault(find(i), []).append(i)
    return {(i, g) for g, m in groups.items() if len(set(m)) > 1 for i in m}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("seed", [0, 1])
def test_all_pairs_under_the_threshold(spark, seed):
    rows = corpus(seed)
    got = {tuple(r) for r in nd.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)
    assert len(got) > 40


def test_pigeonhole_guarantee():
    """However 24 or fewer of 64 symbols change, a key stays equal."""
    r = np.random.default_rng(0)
    sig = r.integers(0, 1 << 16, (300, nd.N_HASH)).astype(np.uint16)
    other = sig.copy()
    for row in other:
        at = r.choice(nd.N_HASH, nd.MAX_DIST, replace=False)
        row[at] ^= 1
    assert (nd.chunk_keys(sig) == nd.chunk_keys(other)).any(axis=1).all()


def test_search_connects_what_all_pairs_connect():
    r = np.random.default_rng(2)
    sig = np.repeat(r.integers(0, 9, (4, nd.N_HASH)), 10, axis=0).astype(np.uint16)
    for row in sig:
        row[r.choice(nd.N_HASH, 14, replace=False)] = 77
    a, b = nd.spanning_edges(np.arange(40), sig)
    assert len(a) == 36 and all(x // 10 == y // 10 for x, y in zip(a, b))


def test_filter_keeps_one_of_each_group_and_all_columns(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, "quite another text here", None), (4, None, "z"), (5, "", "w"), (None, "a b c d e f", "n"), (1, "a b c d e f", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, group_id string").withColumnRenamed("group_id", "sig")
    out = nd.filter_near(df)
    assert out.columns == df.columns
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([r for r in rows if r[0] != 2], key=str)


def test_empty_table(spark):
    assert nd.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    assert nd.filter_near(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_text(spark):
    r = random.Random(5)
    t = " ".join(r.choice(WORDS) for _ in range(200_000))
    rows = [(1, t, "", "", 0), (2, t + " end", "", "", 0)]
    assert {tuple(r) for r in nd.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()} == {(1, 1), (2, 1)}


def test_texts_of_one_doc_id_are_documents_of_their_own(spark):
    r = random.Random(5)
    text = lambda: " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (4, b + " more"), (5, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, nd.filter_near(df).collect())) == sorted([(1, a), (2, b), (3, c), (3, c)])
    assert {tuple(x) for x in nd.near_groups(df).collect()} == {(1, 1), (2, 1), (2, 2), (4, 2), (3, 3), (5, 3)}


@pytest.mark.parametrize("hot", [1, 3])
def test_split_buckets_lose_no_pair(spark, monkeypatch, hot):
    rows = corpus(3)
    monkeypatch.setattr(nd, "HOT", hot)
    assert {tuple(r) for r in nd.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)


def test_other_chunking_meets_every_pair():
    """Signatures at the greatest distance that counts: some key of the other chunking is equal."""
    r = np.random.default_rng(2)
    for _ in range(200):
        sig = r.integers(0, 1 << 16, (2, nd.N_HASH)).astype(np.uint16)
        sig[1] = sig[0]
        at = r.permutation(nd.N_HASH)[: nd.MAX_DIST]
        sig[1, at] += 1
        for s in (sig, np.ascontiguousarray(sig[:, nd._OTHER])):
            keys = nd.chunk_keys(s)
            assert set(keys[0].tolist()) & set(keys[1].tolist())
