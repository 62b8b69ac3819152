"""Queries: fingerprints over arrays; the vectors of ``embeddings`` stand for grids, sound and frame differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.catalog import query
from sigloom.functions import vectors as vec
from sigloom.operators import dedup as dd
from sigloom.operators import media as md
from sigloom.session import read


def _emb(spark, sf):
    return read(spark, sf, "embeddings")


def _grid(size: int):
    """The vector as a square grid, repeated to fill it."""
    row = lambda i: F.slice(F.flatten(F.array_repeat("embedding", max(1, size * size // 64))), i * size + 1, size)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), row).cast("array<array<double>>")


_SIGNS = "list_sum([CASE WHEN embedding[i] > 0 THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END FOR i IN range(1, 61)])::BIGINT"


def _signs():
    """60 sign bits as a number."""
    bits = F.transform(F.slice("embedding", 1, 60), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a + b)


@query("sign_hash", f"SELECT vec_id, {_SIGNS} AS hash FROM embeddings")
def sign_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _emb(spark, sf).select("vec_id", _signs().alias("hash"))


@query("hamming_pairs", f"WITH h AS (SELECT vec_id, {_SIGNS} AS h FROM embeddings) SELECT x.vec_id AS a, y.vec_id AS b, CAST(bit_count(xor(x.h, y.h)) AS INTEGER) AS distance FROM h x JOIN h y ON x.vec_id < y.vec_id WHERE bit_count(xor(x.h, y.h)) <= 16")
def hamming_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return dd.hamming_pairs(_emb(spark, sf).select(F.col("vec_id").alias("seq"), _signs().alias("hash")), 16, 60)


@query("image_dedup")
def image_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Star clusters of near-equal hashes around the first of each."""
    nodes = _emb(spark, sf).select(F.col("vec_id").alias("seq"), _signs().alias("hash"))
    pairs = dd.hamming_pairs(nodes, 16, 60).select("a", "b", (1 - F.col("distance") / 60.0).alias("similarity"))
    return dd.leaders(nodes, pairs)


@query("dedup_stats")
def dedup_stats(spark: SparkSession, sf: str) -> DataFrame:
    sizes = _emb(spark, sf).select(F.col("vec_id").alias("seq"), (F.col("vec_id") % 100 + 1).alias("size"))
    return dd.cluster_stats(image_dedup(spark, sf), sizes)


@query("dct_hash")
def dct_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _emb(spark, sf).select("vec_id", md.dct_hash(_grid(16)).alias("hash"))


@query("block_hash")
def block_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _emb(spark, sf).select("vec_id", md.block_hash(_grid(8)).alias("hash"))


@query("color_and_composite_hash")
def color_and_composite_hash(spark: SparkSession, sf: str) -> DataFrame:
    h = lambda a: F.transform(F.slice("embedding", a, 16), lambda x: F.abs(x).cast("double"))
    rows = _emb(spark, sf).select("vec_id", md.color_hash(h(1), h(17), h(33)).alias("color"), md.block_hash(_grid(8)).alias("block"))
    return rows.withColumn("composite", md.composite_hash("block", "color"))


@query("hash_similarity")
def hash_similarity(spark: SparkSession, sf: str) -> DataFrame:
    h = block_hash(spark, sf)
    other = h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("hash").alias("other"))
    return h.join(other, "vec_id").select("vec_id", vec.hamming_hex("hash", "other").alias("distance"), vec.hamming_similarity("hash", "other").alias("similarity"), vec.char_similarity("hash", "other").alias("characters"))


@query("video_hash")
def video_hash(spark: SparkSession, sf: str) -> DataFrame:
    """The frames of a label, in order, folded by XOR."""
    frames = F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "hash"))), lambda e: e["hash"])
    return block_hash(spark, sf).join(_emb(spark, sf).select("vec_id", "label"), "vec_id").groupBy("label").agg(frames.alias("f")).select("label", md.xor_hex("f").alias("hash"))


@query("audio_fingerprint")
def audio_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    pcm = F.flatten(F.array_repeat("embedding", 4))
    return _emb(spark, sf).select("vec_id", md.energy_fingerprint(pcm, 8).alias("print"), md.speech_segments(pcm, F.lit(400), 0.12, 0.04).alias("segments"))


def _diffs():
    return F.transform("embedding", lambda x: F.abs(x).cast("double"))


@query("scene_fixed", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS frame FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings) WHERE abs(CAST(embedding[i] AS DOUBLE)) >= 0.2")
def scene_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return _emb(spark, sf).select("vec_id", F.explode(md.scenes_fixed(_diffs(), 0.2)).alias("frame"))


@query("scene_adaptive")
def scene_adaptive(spark: SparkSession, sf: str) -> DataFrame:
    return _emb(spark, sf).select("vec_id", md.scenes_adaptive(_diffs(), 8, 1.5).alias("frames"))


@query("keyframes")
def keyframes(spark: SparkSession, sf: str) -> DataFrame:
    return _emb(spark, sf).select("vec_id", md.keyframes_uniform(F.lit(64), 10).alias("uniform"), md.keyframes_novel(_diffs(), 10, 0.15).alias("novel"))


@query("motion", "SELECT vec_id, CASE WHEN m < 0.02 THEN 'static' WHEN m < 0.1 THEN 'low' WHEN m < 0.3 THEN 'medium' ELSE 'high' END AS motion FROM (SELECT vec_id, list_avg([abs(CAST(x AS DOUBLE)) FOR x IN embedding]) AS m FROM embeddings)")
def motion(spark: SparkSession, sf: str) -> DataFrame:
    return _emb(spark, sf).select("vec_id", md.motion_class(_diffs()).alias("motion"))


def _pixels():
    part = lambda a: F.transform(F.slice("embedding", a, 21), lambda x: (F.abs(x) * 500).cast("int").bitwiseAND(F.lit(255)))
    return F.arrays_zip(part(1).alias("r"), part(22).alias("g"), part(43).alias("b"))


@query("colors")
def colors(spark: SparkSession, sf: str) -> DataFrame:
    rows = _emb(spark, sf).select("vec_id", _pixels().alias("p"))
    rows = rows.select("vec_id", md.dominant_colors("p").alias("c"), md.color_diversity("p").alias("diversity"))
    return rows.select("vec_id", F.size("c").alias("n"), md.color_temperature("c").alias("temperature"), "diversity")


@query(
    "hsl",
    """WITH c AS (SELECT s_suppkey, (s_suppkey * 37 % 256) / 255.0 AS r, (s_suppkey * 91 % 256) / 255.0 AS g, (s_suppkey * 151 % 256) / 255.0 AS b FROM supplier),
m AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM c)
SELECT s_suppkey, round(CASE WHEN hi = lo THEN 0 WHEN hi = r THEN (g - b) / (hi - lo) + CASE WHEN g < b THEN 6 ELSE 0 END WHEN hi = g THEN (b - r) / (hi - lo) + 2 ELSE (r - g) / (hi - lo) + 4 END * 60, 6)::DOUBLE AS h, round(CASE WHEN hi = lo THEN 0 WHEN (hi + lo) / 2 > 0.5 THEN (hi - lo) / (2 - hi - lo) ELSE (hi - lo) / (hi + lo) END, 6)::DOUBLE AS s, round((hi + lo) / 2, 6)::DOUBLE AS l FROM m""",
)
def hsl(spark: SparkSession, sf: str) -> DataFrame:
    k = lambda m: (F.col("s_suppkey") * m % 256).cast("double")
    out = read(spark, sf, "supplier").select("s_suppkey", md.rgb_to_hsl(k(37), k(91), k(151)).alias("c"))
    return out.select("s_suppkey", *[F.round(f"c.{x}", 6).alias(x) for x in "hsl"])
