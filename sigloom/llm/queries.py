"""Queries of the corpus operators, each over the whole of its table, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sigloom.session import read


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents (doc_id, text) with one line left of each group of similar lines."""
    from sigloom.llm.line_dedup import line_dedup

    return line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each contaminated span of every document: doc_id, item_id, first_word, n_words, total_words, action."""
    from sigloom.llm.decontaminate import contaminated

    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, text, n_words, score): the content of every page."""
    from sigloom.llm.html_extract import extract_pages

    return extract_pages(read(spark, sf_dir, "pages"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, group_id) of every document in a group of near duplicates."""
    from sigloom.llm.near_dedup import near_groups

    return near_groups(read(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start_word, n_words, src_doc_id, src_word, total_words): every passage of 50 words or more that occurred before."""
    from sigloom.llm.suffix_dedup import repeats

    return repeats(read(spark, sf_dir, "documents")).drop("th")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, piece_ids, n_pieces, exact) of every document; exact: decoding gives its text back."""
    from sigloom.llm.spm import encoded

    return encoded(read(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line, license, template, reduction, missing, added, differences) of every licence notice or text."""
    from sigloom.llm.license_scan import scan_licenses

    return scan_licenses(read(spark, sf_dir, "documents"))


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a shard: the ids of all documents as Re-Pair grammars."""
    from sigloom.llm.repair import shards

    return shards(read(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, n_turns, escaped_turns, rounds, chat) of every conversation."""
    from sigloom.llm.chat import format_chats

    return format_chats(read(spark, sf_dir, "conversations"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, posterior, good_votes, bad_votes) of the documents whose posterior quality lets them stay."""
    from sigloom.llm.quality import kept

    return kept(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_line_dedup,
        op2_decontaminate,
        op3_html_extraction,
        op4_near_dedup,
        op5_suffix_dedup,
        op6_sentencepiece,
        op7_license_scan,
        op8_token_shards,
        op9_chat_format,
        op10_quality_rules,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; the others are compared with brute force in tests/llm."""
    from sigloom.llm import chat

    return {"op9_chat_format": chat.ORACLE_SQL}
