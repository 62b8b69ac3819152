import random
import re

import pytest

from sigloom.llm import decontaminate as dc

W = "al be co da el fi go hu in jo ka lu mi no or pa".split()


def norm(t):
    return re.findall("[0-9a-zÀ-῿⁰-\U0010ffff]+", (t or "").lower())


def brute(docs, items):
    grams = {}
    for i, t in items:
        w = norm(t)
        k = dc.N if len(w) >= dc.N else len(w)
        if k >= dc.MIN_WORDS:
            for j in range(len(w) - k + 1):
                g = tuple(w[j : j + k])
                grams[g] = min(grams.get(g, i), i)
    out = []
    for d, t in docs:
        w = norm(t)
        hit, item = [False] * len(w), {}
        for k in range(dc.MIN_WORDS, dc.N + 1):
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in grams:
                    for x in range(j, j + k):
                        hit[x] = True
                    item.setdefault(j, grams[tuple(w[j : j + k])])
        # adjacent windows merge to one span
        j = 0
        while j < len(w):
            if hit[j]:
                e = j
                while e < len(w) and hit[e]:
                    e += 1
                out.append((d, min(item[x] for x in item if j <= x < e), j, e - j, len(w), "document" if sum(hit) >= dc.DOC_SHARE * len(w) else "span"))
                j = e
            else:
                j += 1
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice(W) + r.choice(W) for _ in range(n))
    items = [(i, text(r.choice([3, 5, 7, 8, 20, 40]))) for i in range(30)] + [(98, ""), (99, None)]
    docs = []
    for d in range(80):
        w = text(r.randint(0, 80)).split()
        if r.random() < 0.5:
            at = r.randint(0, len(w))
            piece = (r.choice(items)[1] or "").split()
            a = r.randint(0, max(0, len(piece) - 9))
            w[at:at] = [x.upper() + r.choice(["", ",", "!", " —"]) for x in piece[a:]]
        docs.append((d, " ".join(w)))
    return docs + [(100, None), (101, "")], items


@pytest.mark.parametrize("limit", [dc.BROADCAST_BYTES, -1])
@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force_either_way(spark, seed, limit, monkeypatch):
    docs, items = corpus(seed)
    docs += docs[:7]  # repeated rows
    monkeypatch.setattr(dc.scan, "__defaults__", (limit,))
    monkeypatch.setattr(dc, "BLOOM_BITS", 14)
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute(docs, items)


def test_cut_leaves_the_rest(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [
        (1, "Before it. One, two three FOUR five six seven eight nine ten And a good deal of text after it all", "a"),
        (2, item, "b"),
        (3, "clean text", "c"),
        (4, None, "d"),
        (5, "", None),
        (None, "clean too", "f"),
        (7, "w " * 200_000 + item, "g"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, spans string")
    out = dc.decontaminate(df, spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {1: "Before it. And a good deal of text after it all", 3: "clean text", 4: None, 5: "", None: "clean too", 7: "w " * 200_000}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(docs, none).count() == 0
    assert [r.text for r in dc.decontaminate(docs, none).collect()] == ["some text"]
    assert dc.decontaminate(docs.limit(0), none).count() == 0


def test_cut_is_the_same_either_way(spark, monkeypatch):
    docs, items = corpus(2)
    monkeypatch.setattr(dc, "BLOOM_BITS", 14)
    df, bench = spark.createDataFrame(docs + docs[:7], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, two = (sorted(map(tuple, dc.decontaminate(df, bench, limit).collect()), key=str) for limit in (dc.BROADCAST_BYTES, -1))
    assert one == two and 0 < len(set(one) - set(docs)) and len(one) < len(docs) + 7
