"""Queries: shapers, gates, routers, predicates and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.catalog import query
from sigloom.functions import shapers as sh
from sigloom.session import read


def _x(spark, sf):
    """Event values brought to about 0..1, some of them missing."""
    x = F.when(F.col("event_id") % 17 != 0, F.col("value") / 100.0)
    return read(spark, sf, "events").select("event_id", "user_id", "event_type", "ts", x.alias("x"), (F.col("event_id") % 7 / 7.0).alias("y"))


_X = "x AS (SELECT event_id, user_id, event_type, ts, CASE WHEN event_id % 17 <> 0 THEN value / 100.0 END AS x, (event_id % 7) / 7.0 AS y FROM events)"


@query("clamp", f"WITH {_X} SELECT event_id, CASE WHEN x IS NOT NULL THEN round(greatest(0.2, least(0.8, x)), 9) END AS v, abs(greatest(0.2, least(0.8, x)) - x) > 1e-4 AND x IS NOT NULL AS limited FROM x")
def clamp(spark: SparkSession, sf: str) -> DataFrame:
    return _x(spark, sf).select("event_id", F.round(sh.clamp("x", 0.2, 0.8), 9).alias("v"), F.coalesce(sh.is_limited("x", 0.2, 0.8), F.lit(False)).alias("limited"))


@query("attenuvert", f"WITH {_X} SELECT event_id, CASE WHEN x IS NOT NULL THEN round(greatest(-1, least(1, x * -1.5 + 0.25)), 9) END AS v FROM x")
def attenuvert(spark: SparkSession, sf: str) -> DataFrame:
    return _x(spark, sf).select("event_id", F.round(sh.attenuvert("x", -1.5, 0.25), 9).alias("v"))


_OPS = {"gt": "x > 0.5", "gte": "x >= 0.5", "lt": "x < 0.5", "lte": "x <= 0.5", "eq": "abs(x - 0.5) < 1e-4", "ne": "abs(x - 0.5) >= 1e-4"}


@query("compare", f"WITH {_X} SELECT event_id, " + ", ".join(f"{s} AS is_{o}" for o, s in _OPS.items()) + ", round(x - 0.5, 9) AS diff FROM x")
def compare(spark: SparkSession, sf: str) -> DataFrame:
    return _x(spark, sf).select("event_id", *[sh.compare("x", o, 0.5).alias(f"is_{o}") for o in _OPS], F.round(F.col("x") - 0.5, 9).alias("diff"))


@query("gate", f"WITH {_X} SELECT event_id, CASE WHEN x >= 0.5 THEN round(x, 9) END AS v, coalesce(x < 0.5, true) AS blocked FROM x")
def gate(spark: SparkSession, sf: str) -> DataFrame:
    g = sh.gate("x", "gte", 0.5)
    return _x(spark, sf).select("event_id", F.round(g, 9).alias("v"), g.isNull().alias("blocked"))


@query("quantize", f"WITH {_X} SELECT event_id, CASE WHEN x IS NOT NULL THEN round(greatest(0, least(7, round_even(x * 7, 0))) / 7, 9) END AS v FROM x")
def quantize(spark: SparkSession, sf: str) -> DataFrame:
    return _x(spark, sf).select("event_id", F.round(sh.quantize("x", 8), 9).alias("v"))


@query(
    "mix",
    f"WITH {_X} SELECT event_id, round(coalesce(x, 0) + y, 9) AS s, round(CASE WHEN x IS NULL THEN y ELSE greatest(x, y) END, 9) AS hi, round(CASE WHEN x IS NULL THEN y ELSE least(x, y) END, 9) AS lo, round(CASE WHEN x IS NULL THEN y ELSE (x + y) / 2 END, 9) AS mean FROM x",
)
def mix(spark: SparkSession, sf: str) -> DataFrame:
    m = {"s": "sum", "hi": "max", "lo": "min", "mean": "average"}
    return _x(spark, sf).select("event_id", *[F.round(sh.mix(["x", "y"], how), 9).alias(c) for c, how in m.items()])


@query("switch", f"WITH {_X} SELECT event_id, CASE WHEN y > 0.5 THEN round(x, 9) ELSE 0.0 END AS v, CASE WHEN y > 0.5 THEN 'A' ELSE 'B' END AS side FROM x")
def switch(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("y") > 0.5
    return _x(spark, sf).select("event_id", sh.switch(c, F.round("x", 9)).alias("v"), sh.switch(c, F.lit("A"), F.lit("B")).alias("side"))


@query("threshold", f"WITH {_X} SELECT event_id, x >= 0.5 AS passed, x > 0.5 AS exceeded FROM x")
def threshold(spark: SparkSession, sf: str) -> DataFrame:
    return _x(spark, sf).select("event_id", sh.passed("x").alias("passed"), sh.exceeded("x").alias("exceeded"))


@query("route_threshold", f"WITH {_X} SELECT event_id, CASE WHEN x >= 0.5 THEN 'route_high' ELSE 'route_low' END AS route FROM x")
def route_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return _x(spark, sf).select("event_id", sh.route_threshold("x").alias("route"))


@query("route_range", f"WITH {_X} SELECT event_id, CASE WHEN x BETWEEN 0 AND 0.25 THEN 'low' WHEN x BETWEEN 0.25 AND 0.75 THEN 'mid' ELSE 'route_default' END AS route FROM x")
def route_range(spark: SparkSession, sf: str) -> DataFrame:
    return _x(spark, sf).select("event_id", sh.route_range("x", [("low", 0, 0.25), ("mid", 0.25, 0.75)]).alias("route"))


@query("route_match", "SELECT event_id, CASE lower(event_type) WHEN 'click' THEN 'a' WHEN 'purchase' THEN 'b' ELSE 'route_default' END AS route FROM events")
def route_match(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", sh.route_match("event_type", {"Click": "a", "PURCHASE": "b"}).alias("route"))


@query("route_contains", "SELECT event_id, CASE WHEN contains(lower(event_type), 'c') THEN 'has_c' WHEN contains(lower(event_type), 'o') THEN 'has_o' ELSE 'route_default' END AS route FROM events")
def route_contains(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", sh.route_contains("event_type", {"C": "has_c", "o": "has_o"}).alias("route"))


@query("sample_hold", f"WITH {_X} SELECT event_id, user_id, round(last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 9) AS held FROM x")
def sample_hold(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    return _x(spark, sf).select("event_id", "user_id", F.round(sh.sample_hold("x", w), 9).alias("held"))


@query("debounce", "SELECT event_id, coalesce(lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts) >= 3600000000, true) AS fires FROM events")
def debounce(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf, "events").select("event_id", sh.debounce("ts", w, 3_600_000).alias("fires"))


@query("delay", "SELECT event_id, epoch_us(ts) + 250000 AS due_us FROM events")
def delay(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", F.unix_micros(sh.delayed("ts", 250)).alias("due_us"))


@query(
    "slew",
    """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, epoch_us(ts) AS us, value AS x FROM events),
s AS (SELECT user_id, i, us, x AS y FROM e WHERE i = 1 UNION ALL
      SELECT e.user_id, e.i, e.us, s.y + CASE WHEN e.x >= s.y THEN least(e.x - s.y, (e.us - s.us) / 1000.0 / 3600000.0) ELSE -least(s.y - e.x, (e.us - s.us) / 1000.0 / 1800000.0) END FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
SELECT user_id, CAST(i - 1 AS INTEGER) AS pos, round(y, 6) AS y FROM s""",
)
def slew(spark: SparkSession, sf: str) -> DataFrame:
    e = F.array_sort(F.collect_list(F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", F.col("value").alias("x"))))
    per = read(spark, sf, "events").groupBy("user_id").agg(e.alias("e"))
    return per.select("user_id", F.posexplode(sh.slew(F.col("e"), 3_600_000, 1_800_000)).alias("pos", "y")).withColumn("y", F.round("y", 6))


@query(
    "triggers",
    "SELECT event_id, true AS has_type, event_type = 'click' AS is_click, (event_type = 'click' AND value >= 50) AS all_hold, (event_type = 'click' OR value >= 50) AS any_holds FROM events",
)
def triggers(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "events").select("event_id", "value", F.create_map(F.lit("type"), F.col("event_type")).alias("signals"))
    click, high = sh.signal_equals("signals", "type", "click"), sh.score_at_least("value", 50)
    return rows.select("event_id", sh.signal_exists("signals", "type").alias("has_type"), click.alias("is_click"), sh.all_of([click, high]).alias("all_hold"), sh.any_of([click, high]).alias("any_holds"))


@query("fingerprint", "SELECT event_id, substr(sha256('type:' || coalesce(event_type, 'null') || '|user:' || coalesce(CAST(user_id AS VARCHAR), 'null')), 1, 16) AS print FROM events")
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", sh.fingerprint({"type": "event_type", "user": "user_id"}).alias("print"))


@query("hashed_value", "SELECT event_id, upper(substr(sha256(event_type), 1, 16)) AS h, round_even(value / 7, 4) AS score FROM events")
def hashed_value(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", sh.hashed_value("event_type").alias("h"), sh.safe_score(F.col("value") / 7).alias("score"))


@query("tier_check", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 3 WHEN 'MACHINERY' THEN 4 ELSE 1 END >= 3 AS ok FROM customer")
def tier_check(spark: SparkSession, sf: str) -> DataFrame:
    tier = F.when(F.col("c_mktsegment") == "BUILDING", "Professional").when(F.col("c_mktsegment") == "MACHINERY", "enterprise").otherwise("other")
    return read(spark, sf, "customer").select("c_custkey", sh.meets_tier(tier, "professional").alias("ok"))


@query("pattern_lookup", "SELECT p_partkey, starts_with(p_type, 'ECONOMY') AS prefix, lower(p_name) LIKE '%a' AS ending FROM part")
def pattern_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", sh.matches_pattern("p_type", "ECONOMY*").alias("prefix"), F.lower("p_name").endswith("a").alias("ending"))


@query("json_path", "SELECT event_id, json_extract_string(props, '$.k') AS k, props AS missing FROM events")
def json_path(spark: SparkSession, sf: str) -> DataFrame:
    from sigloom.functions.text import json_path as jp

    return read(spark, sf, "events").select("event_id", jp("props", "k").alias("k"), jp("props", "none.0").alias("missing"))


@query("template", "SELECT event_id, 'User ' || CAST(user_id AS VARCHAR) || ': ' || event_type || '.' AS body FROM events")
def template(spark: SparkSession, sf: str) -> DataFrame:
    from sigloom.functions.text import template as tp

    return read(spark, sf, "events").select("event_id", tp("User {{user}}: {{type}}.", {"user": "user_id", "type": "event_type"}).alias("body"))
