"""Queries: text similarity, statistics, chunks and near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.catalog import query
from sigloom.functions import text as tx
from sigloom.operators import chunking as ch
from sigloom.operators import dedup as dd
from sigloom.session import read


def _pairs(spark, sf):
    """Part names beside their neighbours by key."""
    p = read(spark, sf, "part").select("p_partkey", "p_name")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(q, "p_partkey")


_P = "p AS (SELECT a.p_partkey, a.p_name, b.p_name AS other FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"


@query("levenshtein_sim", f"WITH {_P} SELECT p_partkey, round(1 - levenshtein(lower(p_name), lower(other)) / greatest(length(p_name), length(other)), 9) AS s FROM p")
def levenshtein_sim(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("p_partkey", F.round(tx.levenshtein_similarity("p_name", "other"), 9).alias("s"))


_G = """x AS (SELECT p_partkey, unnest([substr(lower(p_name), i, 2) FOR i IN range(1, length(p_name))]) AS g FROM p),
y AS (SELECT p_partkey, unnest([substr(lower(other), i, 2) FOR i IN range(1, length(other))]) AS g FROM p)"""


@query(
    "jaccard",
    f"WITH {_P}, {_G}, u AS (SELECT p_partkey, count(*) AS n FROM (SELECT DISTINCT * FROM (FROM x UNION FROM y)) GROUP BY ALL), i AS (SELECT p_partkey, count(*) AS n FROM (FROM x INTERSECT FROM y) GROUP BY ALL) SELECT p_partkey, round(coalesce(i.n, 0) / u.n, 9) AS s FROM u LEFT JOIN i USING (p_partkey)",
)
def jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("p_partkey", F.round(tx.jaccard("p_name", "other"), 9).alias("s"))


@query(
    "ngram_cosine",
    f"""WITH {_P}, {_G}, cx AS (SELECT p_partkey, g, count(*) AS n FROM x GROUP BY ALL), cy AS (SELECT p_partkey, g, count(*) AS n FROM y GROUP BY ALL),
nx AS (SELECT p_partkey, sqrt(sum(n * n)) AS n FROM cx GROUP BY ALL), ny AS (SELECT p_partkey, sqrt(sum(n * n)) AS n FROM cy GROUP BY ALL),
d AS (SELECT p_partkey, sum(cx.n * cy.n) AS d FROM cx JOIN cy USING (p_partkey, g) GROUP BY ALL)
SELECT p_partkey, round(coalesce(d, 0) / (nx.n * ny.n), 9) AS s FROM nx JOIN ny USING (p_partkey) LEFT JOIN d USING (p_partkey)""",
)
def ngram_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("p_partkey", F.round(tx.ngram_cosine("p_name", "other"), 9).alias("s"))


@query("jaro", f"WITH {_P} SELECT p_partkey, round(jaro_similarity(lower(p_name), lower(other)), 9) AS s FROM p")
def jaro(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("p_partkey", F.round(tx.jaro("p_name", "other"), 9).alias("s"))


_JW = "j + 0.1 * (1 - j) * (CASE WHEN left(a, 4) = left(b, 4) AND length(a) > 3 AND length(b) > 3 THEN 4 WHEN left(a, 3) = left(b, 3) THEN 3 WHEN left(a, 2) = left(b, 2) THEN 2 WHEN left(a, 1) = left(b, 1) THEN 1 ELSE 0 END)"


@query("jaro_winkler", f"WITH {_P}, s AS (SELECT p_partkey, lower(p_name) AS a, lower(other) AS b, jaro_similarity(lower(p_name), lower(other)) AS j FROM p) SELECT p_partkey, round({_JW}, 9) AS s FROM s")
def jaro_winkler(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("p_partkey", F.round(tx.jaro_winkler("p_name", "other"), 9).alias("s"))


@query("combined_similarity")
def combined_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("p_partkey", F.round(tx.combined_similarity("p_name", "other"), 9).alias("s"))


@query(
    "text_stats",
    r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \t\n\r]+')) AS INTEGER) AS words, CAST(len(list_filter(string_split_regex(text, '\n\s*\n'), lambda p: trim(p) <> '')) AS INTEGER) AS paragraphs,
CAST(len(regexp_extract_all(text || ' ', '[.!?]+\s')) AS INTEGER) AS sentences,
round(CASE WHEN len(regexp_extract_all(text, '[^ \t\n\r]+')) > 0 THEN length(regexp_replace(text, '\s', '', 'g')) / len(regexp_extract_all(text, '[^ \t\n\r]+')) ELSE 0 END, 9) AS mean_length FROM documents""",
)
def text_stats(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", tx.word_count("text").alias("words"), tx.paragraph_count("text").alias("paragraphs"), tx.sentence_count("text").alias("sentences"), F.round(tx.average_word_length("text"), 9).alias("mean_length"))


_C = r"""c AS (SELECT doc_id, text, lower(text) AS t FROM documents)"""
_n = lambda p, x="t": f"len(regexp_extract_all({x}, '{p}'))"
_WB = r"(?:^|[^a-z0-9_])"


@query(
    "content_type",
    rf"""WITH {_C}, s AS (SELECT doc_id,
 CASE WHEN {_n(r'\b(?:asked|replied|said|shouted|whispered)\b')} > 3 THEN 3 ELSE 0 END + CASE WHEN {_n(r'\b(?:s?he|they)\s+(?:felt|looked|ran|thought|walked)\b')} > 2 THEN 3 ELSE 0 END + CASE WHEN contains(t, 'chapter') THEN 2 ELSE 0 END + CASE WHEN {_n('"[^"]+"', 'text')} > 5 THEN 2 ELSE 0 END AS f,
 CASE WHEN {_n(r'\b(?:api|class|function|http|json|method)\b')} > 2 THEN 3 ELSE 0 END + CASE WHEN {_n(r'\b(?:configure|database|docker|install|kubernetes)\b')} > 1 THEN 2 ELSE 0 END + CASE WHEN regexp_matches(text, '```[\s\S]*?```') THEN 3 ELSE 0 END + CASE WHEN contains(t, 'introduction') OR contains(t, 'conclusion') THEN 1 ELSE 0 END AS k FROM c)
SELECT doc_id, CASE WHEN f > k + 3 THEN 'narrative' WHEN k > f + 3 THEN 'expository' ELSE 'unknown' END AS kind FROM s""",
)
def content_type(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", tx.content_type("text").alias("kind"))


_hit = lambda ws: " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in ws)


@query(
    "sentiment",
    f"WITH c AS (SELECT conv_id, turn, {_hit(tx.POSITIVE)} AS p, {_hit(tx.NEGATIVE)} AS n FROM conversations), s AS (SELECT *, CASE WHEN p + n > 0 THEN (p - n) / (p + n) ELSE 0.0 END AS s FROM c) SELECT conv_id, turn, round(s, 9) AS score, CASE WHEN s > 0.2 THEN 'positive' WHEN s < -0.2 THEN 'negative' ELSE 'neutral' END AS label, round(CASE WHEN p + n > 0 THEN 0.6 + 0.3 * abs(s) ELSE 0.5 END, 9) AS confidence FROM s",
)
def sentiment(spark: SparkSession, sf: str) -> DataFrame:
    s = read(spark, sf, "conversations").select("conv_id", "turn", tx.sentiment("text").alias("s"))
    return s.select("conv_id", "turn", F.round("s.score", 9).alias("score"), "s.label", F.round("s.confidence", 9).alias("confidence"))


_Q = r"""q AS (SELECT doc_id, source, text, len(regexp_extract_all(text, '\p{L}')) AS a, len(regexp_extract_all(text, '\p{Lu}')) AS u, len(regexp_extract_all(text, '[aeiouAEIOU]')) AS v, len(regexp_extract_all(text, '[^ \t\n\r]+')) AS w FROM documents),
g AS (SELECT doc_id, source, CASE WHEN a < 10 THEN 'Empty' WHEN (u / a > 0.4 OR v / a < 0.15) AND a > 50 THEN 'Garbage' WHEN v / a < 0.25 OR u / a > 0.25 THEN 'Low' WHEN w < 20 THEN 'Medium' ELSE 'High' END AS grade FROM q)"""


@query("text_quality", f"WITH {_Q} SELECT doc_id, grade FROM g")
def text_quality(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", tx.text_quality("text").alias("grade"))


@query(
    "overall_quality",
    f"""WITH {_Q}, k AS (SELECT source, count(*) // 2 AS h, count_if(grade = 'Garbage') AS gg, count_if(grade = 'Empty') AS e, count_if(grade = 'Low') AS l, count_if(grade = 'High') AS hi FROM g GROUP BY source)
SELECT source, CASE WHEN gg > h THEN 'Garbage' WHEN e > h THEN 'Empty' WHEN l + gg > h THEN 'Low' WHEN hi > h THEN 'High' ELSE 'Medium' END AS grade FROM k""",
)
def overall_quality(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "documents").select("source", tx.text_quality("text").alias("g"))
    return rows.groupBy("source").agg(tx.overall_quality("g").alias("grade"))


_CHUNKS = """w AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 512 THEN 1 ELSE CAST(ceil((len(w) - 512) / 384.0) AS BIGINT) + 1 END)) AS i FROM w)"""


@query("sliding_chunks", f"WITH {_CHUNKS} SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(i * 384 AS INTEGER) AS start, CAST(least(i * 384 + 512, len(w)) AS INTEGER) AS \"end\", md5(array_to_string(w[i * 384 + 1 : i * 384 + 512], ' ')) AS text_md5 FROM s")
def sliding_chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = ch.chunk_rows(read(spark, sf, "documents"), ch.sliding("text"))
    return rows.select("doc_id", "chunk_index", "start", "end", F.md5("text").alias("text_md5"))


@query(
    "position_weight",
    f"WITH {_CHUNKS}, n AS (SELECT doc_id, i, i / count(*) OVER (PARTITION BY doc_id) AS place FROM s) SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(CASE WHEN place < 0.12 THEN 1.3 WHEN place >= 0.88 THEN 1.2 ELSE 1.0 END AS DOUBLE) AS weight FROM n",
)
def position_weight(spark: SparkSession, sf: str) -> DataFrame:
    return ch.weighted(ch.chunk_rows(read(spark, sf, "documents"), ch.sliding("text"))).select("doc_id", "chunk_index", "weight")


@query("sentence_chunks")
def sentence_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return ch.chunk_rows(read(spark, sf, "documents"), ch.by_sentence("text"))


@query("paragraph_chunks")
def paragraph_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return ch.chunk_rows(read(spark, sf, "documents"), ch.by_paragraph(F.replace("text", F.lit("\n"), F.lit("\n\n"))))


@query("section_chunks")
def section_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return ch.chunk_rows(read(spark, sf, "documents"), ch.by_section(F.regexp_replace("text", r"(?m)^(\S+\.)$", "# $1")))


@query("recursive_chunks")
def recursive_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(ch.recursive("text")).alias("chunk_index", "text"))


@query("exact_dedup", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


def _names(spark, sf):
    return read(spark, sf, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("text"))


@query(
    "similar_names",
    """WITH d AS (SELECT p_partkey AS seq, lower(p_name) AS t, list_distinct([substr(lower(p_name), i, 2) FOR i IN range(1, length(p_name))]) AS g FROM part)
SELECT x.seq AS a, y.seq AS b, round(len(list_intersect(x.g, y.g)) / len(list_distinct(x.g || y.g)), 9) AS similarity FROM d x JOIN d y ON x.seq < y.seq WHERE len(list_intersect(x.g, y.g)) / len(list_distinct(x.g || y.g)) >= 0.85 - 1e-12""",
)
def similar_names(spark: SparkSession, sf: str) -> DataFrame:
    return dd.jaccard_pairs(_names(spark, sf)).withColumn("similarity", F.round("similarity", 9))


@query(
    "similar_names_levenshtein",
    """WITH d AS (SELECT p_partkey AS seq, lower(p_name) AS t FROM part)
SELECT x.seq AS a, y.seq AS b, round(1 - levenshtein(x.t, y.t) / greatest(length(x.t), length(y.t)), 9) AS similarity FROM d x JOIN d y ON x.seq < y.seq WHERE abs(length(x.t) - length(y.t)) <= 0.15 * greatest(length(x.t), length(y.t)) AND 1 - levenshtein(x.t, y.t) / greatest(length(x.t), length(y.t)) >= 0.85 - 1e-12""",
)
def similar_names_levenshtein(spark: SparkSession, sf: str) -> DataFrame:
    return dd.levenshtein_pairs(_names(spark, sf)).withColumn("similarity", F.round("similarity", 9))


@query("leader_dedup")
def leader_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dd.leader_dedup(_names(spark, sf))


@query("searchable_text", "SELECT c_custkey, trim(c_name) || ' ' || trim(c_mktsegment) AS t FROM customer")
def searchable_text(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").select("c_custkey", tx.searchable("c_name", "c_mktsegment").alias("t"))
