"""The corpus pipeline: five stages over documents, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() applies them
in order. All but the last return the columns of documents, extra ones included
and whatever their names; the last adds piece_ids and exact.

In every stage rows are judged by doc_id and text: repeated rows (both equal)
share their fate, ties go to the least doc_id, a null doc_id is a value like
others, very long texts are read whole, and an empty table gives an empty one.
A null or an empty text goes in quality_rules, since it has no words; each later
stage by itself leaves it as it is.

Line dedup comes before near-dedup, so much of a near copy is gone before it is
compared; what near_dedup then finds are copies whose lines differ throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigloom.llm.decontaminate import decontaminate
from sigloom.llm.graph import checkpoint
from sigloom.llm.line_dedup import line_dedup
from sigloom.llm.near_dedup import filter_near
from sigloom.llm.quality import filter_quality
from sigloom.llm.spm import encode
from sigloom.session import read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is too low go, and those without words."""
    return filter_quality(docs)


def fuzzy_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of similar lines stays; a document that loses all its lines goes. Blank lines, null and empty texts stay."""
    return line_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least doc_id. Documents without words or doc_id are in no group."""
    return filter_near(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that mostly consist of them go. Null and empty texts stay."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, and whether they decode to its text; both null for a null text."""
    return encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", fuzzy_lines),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_passages),
    ("sentencepiece", sentence_pieces),
]


#: Stages whose result is written: the next one reads it more than once or, after
#: decontamination, would hold a second Python worker for each running task.
_WRITTEN = {"quality_rules", "line_dedup", "decontamination"}


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name in _WRITTEN:
            docs = checkpoint(docs)
    return docs


#: EM, MinHash search and backtracking are beyond SQL: tests/llm compares run() with a brute-force version.
ORACLE_SQL = None
