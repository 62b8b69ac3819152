"""Queries: workflow graphs as tables (validation, dependencies, order)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom import pipeline as pl
from sigloom.catalog import query
from sigloom.session import read


def _graph(spark, sf):
    """Nations as nodes and regions as manifests, some edges dangling."""
    n = read(spark, sf, "nation")
    nodes = n.select(F.col("n_nationkey").cast("string").alias("id"), F.when(F.col("n_regionkey") < 4, F.col("n_regionkey").cast("string")).otherwise("none").alias("manifest"))
    edges = n.select(F.col("n_nationkey").cast("string").alias("source"), F.concat(F.lit("s"), F.col("n_regionkey")).alias("signal"), (F.col("n_nationkey") * 2).cast("string").alias("target"))
    return nodes, edges


@query(
    "validate_nodes",
    "SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_regionkey < 4 THEN CAST(n_regionkey AS VARCHAR) ELSE 'none' END AS manifest FROM nation WHERE n_regionkey >= 4",
)
def validate_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _ = _graph(spark, sf)
    manifests = read(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("manifest"))
    return pl.unknown_manifests(nodes, manifests)


@query("validate_edges", "SELECT CAST(n_nationkey AS VARCHAR) AS source, 's' || n_regionkey AS signal, CAST(n_nationkey * 2 AS VARCHAR) AS target, 'target' AS missing FROM nation WHERE n_nationkey * 2 NOT IN (SELECT n_nationkey FROM nation)")
def validate_edges(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _graph(spark, sf)
    return pl.dangling_edges(nodes, edges)


@query(
    "dependency_graph",
    """WITH e AS (SELECT event_type AS producer, CAST(user_id AS VARCHAR) AS signal, count(*) AS n FROM events WHERE user_id < 5 GROUP BY ALL),
r AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS signal, event_type AS consumer FROM events WHERE user_id < 5 AND event_id % 3 = 0),
j AS (SELECT consumer, producer, signal, row_number() OVER (PARTITION BY consumer, signal ORDER BY producer DESC) AS rn FROM e JOIN r USING (signal) WHERE producer <> consumer)
SELECT consumer, producer, signal FROM j WHERE rn = 1""",
)
def dependency_graph(spark: SparkSession, sf: str) -> DataFrame:
    few = read(spark, sf, "events").filter("user_id < 5").withColumn("signal", F.col("user_id").cast("string"))
    emits = few.select(F.col("event_type").alias("component"), "signal").distinct().withColumn("seq", F.col("component"))
    requires = few.filter("event_id % 3 = 0").select(F.col("event_type").alias("component"), "signal").distinct()
    return pl.dependencies(emits, requires)


@query(
    "dependency_graph_all",
    """WITH e AS (SELECT DISTINCT event_type AS component, CAST(user_id AS VARCHAR) AS signal FROM events),
j AS (SELECT r.component AS consumer, e.component AS producer, signal, row_number() OVER (PARTITION BY r.component, signal ORDER BY e.component DESC) AS rn FROM e JOIN e r USING (signal) WHERE e.component <> r.component)
SELECT consumer, producer, signal FROM j WHERE rn = 1""",
)
def dependency_graph_all(spark: SparkSession, sf: str) -> DataFrame:
    """Of the whole table: each event type emits and requires the signals of all its users."""
    every = read(spark, sf, "events").select(F.col("event_type").alias("component"), F.col("user_id").cast("string").alias("signal")).distinct()
    return pl.dependencies(every.withColumn("seq", F.col("component")), every)


@query("ingest_exclude", "SELECT page_id FROM pages WHERE sha256(html) NOT IN (SELECT sha256(html) FROM pages WHERE page_id % 3 = 0)")
def ingest_exclude(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "pages").withColumn("hash", F.sha2("html", 256))
    return p.join(p.filter("page_id % 3 = 0").select("hash").distinct(), "hash", "left_anti").select("page_id")


@query("ingest_exclude_copies", "SELECT page_id FROM pages WHERE sha256(html) NOT IN (SELECT sha256(html) FROM pages GROUP BY ALL HAVING count(*) > 1)")
def ingest_exclude_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Without the pages whose content the table holds more than once."""
    p = read(spark, sf, "pages").withColumn("hash", F.sha2("html", 256))
    return p.join(p.groupBy("hash").count().filter("count > 1").select("hash"), "hash", "left_anti").select("page_id")


@query("pipeline_graph")
def pipeline_graph(spark: SparkSession, sf: str) -> DataFrame:
    """A declared pipeline: clamp, gate and a grouped reduction of events, compiled to one plan."""
    spec = {
        "nodes": [
            {"id": "in", "operator": "table", "config": {"path": f"{sf}/events.parquet"}},
            {"id": "clamp", "operator": "clamp", "config": {"column": "value", "max": 50.0}},
            {"id": "gate", "operator": "gate", "config": {"column": "value", "op": "gt", "threshold": 5.0}},
            {"id": "sum", "operator": "reduce", "config": {"group": "event_type", "value": "value", "seq": "event_id", "ops": ["sum", "count"]}},
        ],
        "edges": [["in", "clamp"], ["clamp", "gate"], ["gate", "sum"]],
    }
    return pl.compile_graph(spark, spec)["sum"].withColumn("sum_value", F.round("sum_value", 6))
