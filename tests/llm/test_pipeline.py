"""run() against a brute-force version of its stages on a small fixture, and the stages' edge cases."""

import random

import pyarrow as pa
import sentencepiece

import corpus_pipeline as cp
from sigloom.llm import decontaminate as dc
from sigloom.llm import line_dedup as ld
from sigloom.llm import near_dedup as nd
from sigloom.llm import quality as q
from sigloom.llm import spm

from .test_decontaminate import brute as brute_spans
from .test_line_dedup import brute as brute_lines
from .test_near_dedup import brute as brute_near
from .test_quality import row_em

W = "the sea and land of a man who was in it with that for on as by from word time way day".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=0):
    r = random.Random(seed)
    line = lambda n: " ".join(r.choice(W) + r.choice(["", "", "ing", "er", "s"]) for _ in range(n)).capitalize() + "."
    items = [(i, line(20)) for i in range(6)]
    rows = []
    for d in range(60):
        lines = [line(r.randint(8, 40)) for _ in range(r.randint(1, 6))]
        if r.random() < 0.2:
            lines.insert(0, "And here is a line that many documents of this corpus hold.")
        if r.random() < 0.2:
            lines.append(line(10) + " " + r.choice(items)[1] + " " + line(30))
        rows.append("\n".join(lines))
    rows += [rows[3], rows[3], rows[4].replace(" and ", " or "), "### $$$ %%% " * 40, "", None, items[0][1], "SHOUT! NOW!! " * 50]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)], items


def brute(rows, items):
    code = {r[0]: int(q.vote_codes(pa.array([r[1]]))[0]) if r[1] is not None else q.NO_WORDS for r in rows}
    seen = [c for c in code.values() if c != q.NO_WORDS]
    post = dict(zip(seen, row_em(seen)))
    kept = [r for r in rows if code[r[0]] != q.NO_WORDS and round(post[code[r[0]]], 6) >= q.KEEP]
    docs = brute_lines([(r[0], r[1]) for r in kept])
    groups = brute_near([(d, t) for d, t in docs])
    gone = {d for d, g in groups if d != g}
    docs = [(d, t) for d, t in docs if d not in gone]
    spans = {}
    for d, _, a, n, _, action in brute_spans(docs, items):
        spans.setdefault(d, []).append((a, n, action))
    out = {}
    for d, t in docs:
        found = spans.get(d, [])
        if any(x[2] == "document" for x in found):
            continue
        out[d] = (t, [(a, n) for a, n, _ in found])
    return out


def test_run_equals_brute_force(spark, tmp_path):
    rows, items = corpus()
    sf = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = {r.doc_id: r for r in cp.run(spark, sf).collect()}
    want = brute(rows, items)
    assert set(got) == set(want) and 20 < len(want) < len(rows)
    lib = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    cut = 0
    for d, (text, found) in want.items():
        r = got[d]
        assert r.exact and r.piece_ids == lib.encode(r.text)
        if not found:
            assert r.text == text
        else:
            cut += 1
            words = [w for w in __import__("re").findall("[0-9a-z]+", text.lower())]
            left = [w for i, w in enumerate(words) if not any(a <= i < a + n for a, n in found)]
            assert __import__("re").findall("[0-9a-z]+", r.text.lower()) == left
    assert cut >= 3


def test_stages_keep_columns_and_survive_odd_rows(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(0, "one two three four five six seven eight nine")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "the land and the sea " * 20000, "en", "s", 1), (3, "of the sea", None, None, None)]
    full = spark.createDataFrame(rows, SCHEMA)
    for df in (full, full.limit(0)):
        docs = df
        for name, stage in cp.STAGES:
            docs = stage(spark, docs, sf)
            assert docs.columns[:5] == df.columns, name
        assert docs.count() <= len(rows)


def python_workers(df):
    """The most Python workers that a task of the plan holds: steps in Python without an exchange between them."""
    most = 0

    def walk(plan):
        nonlocal most
        if plan.nodeName() == "AdaptiveSparkPlan":
            plan = plan.initialPlan()
        below = sum(walk(plan.children().apply(i)) for i in range(plan.children().size()))
        here = below + (plan.nodeName() == "MapInArrow")
        most = max(most, here)
        return 0 if "Exchange" in plan.nodeName() else here

    walk(df._jdf.queryExecution().executedPlan())
    return most


def test_a_task_holds_one_python_worker(spark, tmp_path):
    """Workers live on between stages: two a task were 600 to 800 MB of an executor in sentencepiece, which broke its limit."""
    rows, items = corpus()
    sf = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in cp.STAGES:
        assert python_workers(stage(spark, docs, sf)) <= 1, name
    assert python_workers(dc.decontaminate(docs, spark.read.parquet(f"{sf}/benchmark.parquet"), limit=0)) == 1
    assert python_workers(cp.run(spark, sf)) == 1


def test_stage_names():
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    assert cp.ORACLE_SQL is None and dc.N > 0 and ld.BANDS > 0 and nd.N_HASH > 0
