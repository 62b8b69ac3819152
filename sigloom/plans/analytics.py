"""Queries: event dashboards, time series and metering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.catalog import query
from sigloom.operators import windows as wn
from sigloom.session import read


def _events(spark, sf):
    return read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "dashboard_summary",
    """WITH e AS (SELECT event_type, CAST(user_id AS VARCHAR) AS u, value FROM events WHERE ts >= TIMESTAMP '2024-01-10'),
s AS (SELECT 'type' AS facet, event_type AS name, count(*) AS n, avg(value) AS a FROM e GROUP BY event_type UNION ALL SELECT 'user', u, count(*), avg(value) FROM e GROUP BY u UNION ALL SELECT 'all', 'all', count(*), coalesce(avg(value), 0) FROM e)
SELECT facet, name, n, round(a, 6) AS avg_value, round(n / 3600.0, 9) AS per_second FROM s""",
)
def dashboard_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = wn.dashboard_summary(_events(spark, sf), F.lit("2024-01-10").cast("timestamp"), 3600.0, {"type": "event_type", "user": "user_id"}, "ts", "value")
    return out.select("facet", "name", "n", F.round("avg_value", 6).alias("avg_value"), F.round("per_second", 9).alias("per_second"))


@query(
    "time_series",
    """WITH b AS (SELECT epoch_us(TIMESTAMP '2024-01-01 00:30:00') + i * 21600000000 AS bucket_us FROM range(0, 80) t(i)),
e AS (SELECT epoch_us(ts) AS us, value FROM events WHERE ts >= TIMESTAMP '2024-01-01 00:30:00' AND ts < TIMESTAMP '2024-01-21 00:30:00')
SELECT bucket_us, count(us) AS n, round(coalesce(sum(value), 0), 6) AS total FROM b LEFT JOIN e ON us >= bucket_us AND us < bucket_us + 21600000000 GROUP BY bucket_us""",
)
def time_series(spark: SparkSession, sf: str) -> DataFrame:
    return wn.time_series(_events(spark, sf), "ts", "value", "2024-01-01 00:30:00", "2024-01-21 00:30:00", 21_600).withColumn("total", F.round("total", 6))


@query(
    "time_series_all",
    """WITH m AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events), b AS (SELECT unnest(range(lo, hi + 1, 21600000000)) AS bucket_us FROM m),
e AS (SELECT lo + (epoch_us(ts) - lo) // 21600000000 * 21600000000 AS bucket_us, count(*) AS n, sum(value) AS total FROM events, m WHERE ts IS NOT NULL GROUP BY 1)
SELECT bucket_us, coalesce(n, 0) AS n, round(coalesce(total, 0), 6) AS total FROM b LEFT JOIN e USING (bucket_us)""",
)
def time_series_all(spark: SparkSession, sf: str) -> DataFrame:
    """From the table's least time to its greatest."""
    e = _events(spark, sf)
    start, end = e.agg(F.min("ts").cast("string"), (F.max("ts") + F.expr("interval 1 microsecond")).cast("string")).first()
    return wn.time_series(e, "ts", "value", start, end, 21_600).withColumn("total", F.round("total", 6))


@query("distinct_values", "SELECT event_type AS value, min(event_id) AS first_seq FROM events GROUP BY event_type ORDER BY first_seq LIMIT 4")
def distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    return wn.distinct_values(read(spark, sf, "events"), "event_type", "event_id", 4)


@query("event_page", "SELECT event_id, event_type FROM events WHERE value >= 20 AND user_id < 50 ORDER BY event_id DESC OFFSET 20 LIMIT 30")
def event_page(spark: SparkSession, sf: str) -> DataFrame:
    return wn.event_page(read(spark, sf, "events"), [F.col("value") >= 20, F.col("user_id") < 50], "event_id", 20, 30).select("event_id", "event_type")


@query("event_page_as_stored", "SELECT event_id, event_type FROM (SELECT * FROM events WHERE value >= 20 ORDER BY event_id OFFSET 20 LIMIT 30)")
def event_page_as_stored(spark: SparkSession, sf: str) -> DataFrame:
    return wn.event_page(read(spark, sf, "events"), [F.col("value") >= 20], "event_id", 20, 30, page_first=True).select("event_id", "event_type")


_LEVEL = "round(used / 200 * 100, 6) AS percent, round(CASE WHEN used <= 160 THEN 1.0 WHEN used >= 200 THEN 0.0 ELSE (100 - used / 2) / 20 END, 6) AS throttle, CASE WHEN used >= 200 THEN 100 WHEN used >= 180 THEN 90 WHEN used >= 160 THEN 80 ELSE 0 END AS level"


def _meter_sql(by: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    key = f"{by}, " if by else ""
    return f"""WITH s AS (SELECT {key}epoch_us(ts) // 1000000 AS second, sum(value) AS units FROM events GROUP BY ALL),
u AS (SELECT {key}second, sum(units) OVER ({part}ORDER BY second RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS used FROM s)
SELECT {key}second, round(used, 6) AS used, {_LEVEL} FROM u"""


def _meter(spark, sf, by):
    out = wn.meter(_events(spark, sf), "ts", F.col("value"), 200.0, 3600, by)
    return out.select(*by, "second", *[F.round(c, 6).alias(c) for c in ("used", "percent", "throttle")], "level")


@query("meter_throttle", _meter_sql(""))
def meter_throttle(spark: SparkSession, sf: str) -> DataFrame:
    return _meter(spark, sf, [])


@query("meter_by_type", _meter_sql("event_type"))
def meter_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return _meter(spark, sf, ["event_type"])


@query("running_count", "SELECT event_id, row_number() OVER (ORDER BY event_id) AS running FROM events")
def running_count(spark: SparkSession, sf: str) -> DataFrame:
    return wn.running_count(read(spark, sf, "events"), "event_id").select("event_id", F.col("running").cast("long").alias("running"))
