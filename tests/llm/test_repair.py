import random

import numpy as np
import pyarrow as pa
import pytest

from sigloom.llm import repair as rp

BITS = ["a", "b", " ", "  ", "é", "ß", "日", "\n", "\t", "😀", "'s", "the", "ing", "<|endoftext|>", ".", "0", "12", "    ", " ", " ", "\r", "ñ", "!!", "É"]


@pytest.mark.parametrize("seed", [0, 1])
def test_ids_equal_the_library(seed):
    r = random.Random(seed)
    some = ["".join(r.choice(BITS) for _ in range(r.randint(0, 30))) for _ in range(2000)] + ["", " " * 500]
    ids, at = rp.Tokenizer(rp.VOCABULARY)(pa.array(some))
    encode = rp.vocabulary(rp.VOCABULARY).encode_ordinary
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(some))] == [encode(t) for t in some]


@pytest.mark.parametrize("seed", range(6))
def test_grammar_gives_the_ids_back(seed):
    r = np.random.default_rng(seed)
    words = [r.integers(0, 9, r.integers(1, 6)) for _ in range(8)]
    docs = [np.concatenate([words[i] for i in r.integers(0, 8, r.integers(1, 200))]) if r.random() < 0.9 else np.zeros(0, int) for _ in range(20)]
    docs.append(np.full(300, 5))
    ids, at = np.concatenate(docs).astype(np.int32), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    pairs, lengths, seq, starts = rp.compress(ids, at, 9)
    assert len(seq) < 0.7 * len(ids)
    for d, want in enumerate(docs):
        assert (rp.expand(seq[starts[d] : starts[d + 1]], pairs, 9) == want).all()
    for k, n in enumerate(lengths):
        assert len(rp.expand(np.array([9 + k]), pairs, 9)) == n
        assert (pairs[k] < 9 + k).all()


def test_rows_of_all_sorts(spark):
    long = "some words again and again " * 20_000
    rows = [(1, None, "a"), (2, "", "b"), (None, "some text", "c"), (4, long, "d"), (4, long, "d")] + [(10 + i, f"text {i} of the shard", "e") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    encode, seen = rp.vocabulary(rp.VOCABULARY).encode_ordinary, []
    r = random.Random(0)
    for row in rp.shards(df).collect():
        shard = row.asDict()
        for d, doc in enumerate(shard["doc_ids"]):
            ids = rp.decode(shard, d)
            seen.append((doc, None if ids is None else tuple(ids.tolist())))
            if ids is not None and len(ids):
                a = r.randrange(len(ids))
                b = r.randint(a, len(ids))
                assert rp.decode(shard, d, a, b).tolist() == ids.tolist()[a:b]
    assert sorted(seen, key=str) == sorted([(i, None if t is None else tuple(encode(t))) for i, t, _ in rows], key=str)
    assert rp.shards(df.limit(0)).count() == 0


@pytest.mark.parametrize("first_new", [60_000, 1 << 23])
def test_rare_pairs_beside_a_leading_one_are_replaced(first_new):
    r = np.random.default_rng(0)
    pairs = [(0, 1)] * 400 + [(2 * k, 2 * k + 1) for k in range(1, 91) for _ in range(90)]
    parts = [[p[0], p[1], 200 + (7919 * i) % 59_000] for i, p in enumerate(pairs)]
    ids = np.concatenate([parts[i] for i in r.permutation(len(parts))] + [np.arange(200, 59_200)]).astype(np.int32)
    at = np.array([0, len(ids)])
    rules, _, seq, _ = rp.compress(ids, at, first_new)
    assert (rp.expand(seq, rules, first_new) == ids).all()
    assert {tuple(x) for x in rules.tolist()} >= set(pairs)
    assert len(seq) <= len(ids) - len(pairs)


def brute(docs, first_new, least):
    """(rules, symbols left) of Re-Pair with one pair at a time, each count taken anew."""
    docs, rules = [list(map(int, d)) for d in docs], 0
    while True:
        uses = {}
        for d in docs:
            seen = {}
            for i, pair in enumerate(zip(d, d[1:])):
                if seen.get(pair) != i - 1:
                    uses[pair] = uses.get(pair, 0) + 1
                    seen[pair] = i
                else:
                    seen[pair] = None
        pair, n = max(uses.items(), key=lambda x: (x[1], x[0]), default=(None, 0))
        if n < least:
            return rules, sum(map(len, docs))
        for d in docs:
            out, i = [], 0
            while i < len(d):
                hit = i + 1 < len(d) and (d[i], d[i + 1]) == pair
                out.append(first_new + rules if hit else d[i])
                i += 2 if hit else 1
            d[:] = out
        rules += 1


@pytest.mark.parametrize("seed", range(4))
def test_grammar_is_as_small_as_one_pair_at_a_time_makes_it(seed):
    r = np.random.default_rng(seed)
    words = [r.integers(0, 300, r.integers(1, 5)) for _ in range(120)]
    phrases = [np.concatenate([words[min(119, int(r.zipf(1.4)))] for _ in range(r.integers(2, 9))]) for _ in range(60)]
    docs = [np.concatenate([phrases[r.integers(60)] if r.random() < 0.4 else words[min(119, int(r.zipf(1.3)))] for _ in range(r.integers(5, 60))]) for _ in range(80)]
    ids, at = np.concatenate(docs).astype(np.int32), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    pairs, lengths, seq, starts = rp.compress(ids, at, 300)
    rules, left = brute(docs, 300, rp.MIN_COUNT)
    assert len(seq) + 2 * len(pairs) <= 1.03 * (left + 2 * rules)
    assert (rp.expand(seq, pairs, 300) == ids).all()
    # nothing that pays is left
    again = {}
    for a, b in zip(starts[:-1], starts[1:]):
        for p in set(zip(seq[a:b].tolist(), seq[a + 1 : b].tolist())):
            again[p] = again.get(p, 0) + 1
    assert max(again.values(), default=0) < rp.MIN_COUNT


def test_packed_numbers_come_back():
    for top in (0, 255, 256, 65_536, 1 << 24, (1 << 32) - 1):
        values = np.array([0, top // 2, top], np.uint32)
        assert (rp.unpack(rp.pack(values)) == values).all()
    assert len(rp.unpack(rp.pack(np.zeros(0, np.uint32)))) == 0
