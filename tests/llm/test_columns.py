"""Extra columns of any name pass through every operator and pipeline stage; nulls, empty texts, ties and repeated rows too."""

import pytest

import corpus_pipeline as cp
from sigloom.llm import decontaminate, html_extract, license_scan, line_dedup, near_dedup, quality, repair, spm, suffix_dedup

NAMES = ["a.b", "a`b", "__near_id", "rest", "z", "spans", "row", "gone", "th", "g_id", "g_th", "__g_id", "d_id", "r0", "r3", "hits", "total_words", "want", "words", "h", "did", "code", "sig", "key", "node", "ids", "value", "a b", "ä"]
LONG = "a longer text about bread and rivers in the town where people meet. " * 3000


@pytest.fixture(scope="module")
def docs(spark):
    good = "The people of the town walked to the river and talked about the bread that they had made in the morning. It was a day like all the others, and no one was in a hurry to go home before the night came. The old man told the children of the sea and of the ships that he had seen when he was young."
    texts = [(1, good), (1, good), (2, good + " It rained."), (None, good), (3, None), (4, ""), (5, LONG), (6, "short"), (7, "one line\none line\nanother line of words")]
    rows = [(i, t, *[f"{n}-{k}" if k % 3 else None for n in NAMES]) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join("`" + n.replace("`", "``") + "` string" for n in NAMES))


def extra(row):
    return tuple(row[2 : 2 + len(NAMES)])


def bench(spark):
    return spark.createDataFrame([(1, "an item of the test that no document holds at all")], "item_id long, text string")


MAPS = {
    "op1": lambda s, d: line_dedup.line_dedup(d),
    "op2": lambda s, d: decontaminate.decontaminate(d, bench(s)),
    "op4": lambda s, d: near_dedup.filter_near(d),
    "op5": lambda s, d: suffix_dedup.dedup(d),
    "op6": lambda s, d: spm.encode(d),
    "op10": lambda s, d: quality.filter_quality(d),
}


@pytest.mark.parametrize("name", MAPS)
def test_columns_pass_through(spark, docs, name):
    out = MAPS[name](spark, docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    known = {extra(r) for r in docs.collect()}
    rows = out.collect()
    assert rows and all(extra(r) in known for r in rows)
    empty = MAPS[name](spark, docs.limit(0))
    assert empty.columns[: len(docs.columns)] == docs.columns and empty.count() == 0


def test_columns_are_ignored_where_rows_are_made(spark, docs):
    for out in (line_dedup.dropped_lines(docs), suffix_dedup.repeats(docs), near_dedup.near_groups(docs), license_scan.scan_licenses(docs), repair.shards(docs), quality.score(docs), spm.encoded(docs), decontaminate.contaminated(docs, bench(spark))):
        out.count()
    assert html_extract.extract_pages(docs.selectExpr("doc_id page_id", "text html", "`a.b`", "rest", "z"), {}).count() == docs.count()


def test_columns_of_the_encoding_are_kept(spark):
    df = spark.createDataFrame([(1, "text", "x", 7, "y")], "doc_id long, text string, piece_ids string, exact int, piece_ids_in string")
    out = spm.encode(df)
    assert out.columns == ["doc_id", "text", "piece_ids_in_in", "exact_in", "piece_ids_in", "piece_ids", "exact"]
    row = out.first()
    assert (row.piece_ids_in_in, row.exact_in, row.piece_ids_in, row.exact) == ("x", 7, "y", True)


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, docs, stage, tmp_path):
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    name, run = cp.STAGES[stage]
    out = run(spark, docs, str(tmp_path))
    assert out.columns[: len(docs.columns)] == docs.columns
    known = {extra(r) for r in docs.collect()}
    rows = out.collect()
    assert rows and all(extra(r) in known for r in rows)
    assert run(spark, docs.limit(0), str(tmp_path)).count() == 0
