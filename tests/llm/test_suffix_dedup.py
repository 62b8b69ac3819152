import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from sigloom.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string"
W = [f"{a}{b}" for a in "ba de ki lo mu na pe ri so tu va ze".split() for b in "n r st l m ck".split()]


def brute(rows, k=sd.MIN_WORDS):
    """Words of each document in a window that occurs earlier in (doc_id, text) order, as merged spans."""
    first, out = {}, set()
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        w = (t or "").split()
        hit = [False] * len(w)
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            if g in first:
                hit[i : i + k] = [True] * k
            else:
                first[g] = (d, i)
        i = 0
        while i < len(w):
            if hit[i]:
                j = i
                while j < len(w) and hit[j]:
                    j += 1
                out.add((d, i, j - i, len(w)))
                i = j
            else:
                i += 1
    return out


def corpus(seed):
    r = random.Random(seed)
    text = lambda n: [r.choice(W) for _ in range(n)]
    shared = [text(r.choice([30, 49, 50, 51, 60, 90, 200])) for _ in range(12)]
    rows = []
    for d in range(70):
        w = text(r.randint(0, 150))
        for _ in range(r.randint(0, 3)):
            p = r.choice(shared)
            a = r.randint(0, 10)
            at = r.randint(0, len(w))
            w[at:at] = p[a:]
        if r.random() < 0.2:
            at = r.randint(0, len(w))
            w[at:at] = ["x"] * r.choice([30, 60, 300]) if r.random() < 0.5 else ["y", "z", "z"] * r.choice([10, 40, 100])
        rows.append((d, " ".join(w)))
    rows += [(200 + i, rows[5][1]) for i in range(3)] + [(300, None), (301, ""), (None, " ".join(shared[-1]))]
    return rows


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    got = {(r.doc_id, r.start_word, r.n_words, r.total_words) for r in sd.repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("seed", range(5))
def test_longest_previous_factor(seed):
    r = np.random.default_rng(seed)
    s = r.integers(0, 3, 300)
    n = len(s)
    length, source = sd.longest_previous(s, np.arange(n), np.full(n, n), 64)
    for i in range(n):
        best = max((next((k for k in range(n - i) if s[i + k] != s[j + k]), n - i) for j in range(i)), default=0)
        assert min(length[i], 64) == min(best, 64)
        if length[i]:
            assert source[i] < i and (s[source[i] : source[i] + length[i]] == s[i : i + length[i]]).all()


FULL = ("doc_id", "start_word", "n_words", "src_doc_id", "src_word", "total_words")


def first_places(rows, k=sd.MIN_WORDS):
    """First (doc_id, word) of every window of k words."""
    first = {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        w = (t or "").split()
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i : i + k]), (d, i))
    return first


@pytest.mark.parametrize("seed", [0])
def test_no_column_depends_on_the_sizes_of_blocks_and_hot_anchors(spark, monkeypatch, seed):
    """All columns are the same however many words a kernel call takes and however few snippets make an anchor hot."""
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    run = lambda: sorted((tuple(r[c] for c in FULL) for r in sd.repeats(df).collect()), key=str)
    want = run()
    assert {(r[0], r[1], r[2], r[5]) for r in want} == brute(rows)
    for name, size in [("_BLOCK", 300), ("HOT", 1), ("HOT", 12)]:
        with monkeypatch.context() as m:
            m.setattr(sd, name, size)
            assert run() == want
    # the source is the first place of the first words, but in whole copies (a place in the copied document) and runs of one word
    text, first = {d: (t or "").split() for d, t in rows}, first_places(rows)
    for d, at, n, s, s_at, total in want:
        gram = text[d][at : at + sd.MIN_WORDS]
        assert text[s][s_at : s_at + len(gram)] == gram and ((s is not None, s or 0, s_at) < (d is not None, d or 0, at))
        if n < total and len(set(gram)) > 12:
            assert first[tuple(gram)] == (s, s_at)


def test_hot_anchor(spark, monkeypatch):
    """A passage in hundreds of documents, with other words around it: sources by array and by windows agree."""
    r = random.Random(4)
    p = [r.choice(W) for _ in range(70)]
    rows = []
    for d in range(400):
        w = [r.choice(W) for _ in range(60)]
        a, b = (0, 70) if d % 3 == 0 else (r.randint(0, 12), r.randint(61, 70))
        rows.append((d, " ".join(w[:30] + p[a:b] + w[30:])))
    df = spark.createDataFrame(rows, SCHEMA)
    run = lambda: sorted(tuple(x[c] for c in FULL) for x in sd.repeats(df).collect())
    want = run()
    assert {(x[0], x[1], x[2], x[5]) for x in want} == brute(rows) and len(want) >= 300
    monkeypatch.setattr(sd, "HOT", 20)
    assert run() == want


def test_hot_anchors_of_runs_list_each_window_once(spark, monkeypatch):
    """Runs of one or two words hold an anchor at each place; their windows make no more rows for that."""
    r = random.Random(6)
    rows = []
    for d in range(40):
        w = [r.choice(W) for _ in range(40)]
        run = ["the"] * r.randint(120, 400) if d % 4 else ["y", "z"] * r.randint(40, 90)
        rows.append((d, " ".join(w[:20] + run + w[20:] + (["the"] * r.randint(50, 90) if d % 3 else []))))
    df = spark.createDataFrame(rows, SCHEMA)
    run = lambda: sorted(tuple(x[c] for c in FULL) for x in sd.repeats(df).collect())
    want = run()
    assert {(x[0], x[1], x[2], x[5]) for x in want} == brute(rows)
    monkeypatch.setattr(sd, "HOT", 20)
    assert run() == want
    assert sd.spans(df).count() <= sum(len(t.split()) for _, t in rows)


def test_memory_of_a_group_below_the_hot_limit():
    """The arrays of the largest group that is not split: two tasks of an executor may hold one each."""
    r = np.random.default_rng(0)
    n, size = sd.HOT, sd.MIN_WORDS + sd.REACH - 1
    words = r.integers(0, 1 << 63, (n, size)).astype(np.uint64)
    words[:, 20:75] = words[0, 20:75]
    raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * size * 8).astype(np.int32).tobytes()), pa.py_buffer(words.tobytes())])
    ids, none = pa.array(np.arange(n)), pa.array(np.zeros(n, np.int32))
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), ids, ids, none, none, raw], ["h", "did", "th", "lo", "total", "words"])
    tracemalloc.start()
    try:
        out = sd._flush([batch])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out.num_rows == n - 1 and set(out["n"].to_pylist()) == {55} and set(out["src"].to_pylist()) == {0}
    assert peak < 24 * words.nbytes


def test_dedup_keeps_the_first_copy(spark):
    p = " ".join(W[:60])
    rows = [(1, f"one {p} tail", "a"), (2, f"two {p}  other tail", "b"), (3, p, "c"), (4, None, "d"), (5, "", None), (6, " ".join(W[:40]), "e"), (7, " ".join(W[:40]), "f"), (1, f"one {p} tail", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string")
    out = sd.dedup(df)
    assert out.columns == df.columns
    want = [rows[0], (2, "two other tail", "b"), *rows[3:]]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_empty_table_and_long_text(spark):
    assert sd.repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    r = random.Random(9)
    t = " ".join(r.choice(W) for _ in range(60_000))
    got = sd.repeats(spark.createDataFrame([(1, t), (2, t[:-4] + " end")], SCHEMA)).collect()
    assert [(x.doc_id, x.src_doc_id, x.start_word) for x in got] == [(2, 1, 0)] and got[0].n_words >= 59_998
