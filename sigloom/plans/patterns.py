"""Queries: patterns of events in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.catalog import query
from sigloom.operators import windows as wn
from sigloom.session import read


def _events(spark, sf):
    return read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


#: The reference's default of 10 s finds nothing in these tables: the queries use 12 hours.
HALF_DAY = 43_200.0


@query(
    "window_stats",
    "SELECT user_id, count(*) AS n, min(epoch_us(ts)) AS oldest_us, max(epoch_us(ts)) AS newest_us, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 6) AS span_s, round(CASE WHEN max(ts) > min(ts) THEN count(*) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 6e7) ELSE 0 END, 9) AS per_minute FROM events GROUP BY user_id",
)
def window_stats(spark: SparkSession, sf: str) -> DataFrame:
    return wn.window_stats(_events(spark, sf), "user_id", "ts").withColumn("per_minute", F.round("per_minute", 9)).withColumn("span_s", F.round("span_s", 6))


_BURST = """SELECT user_id, event_id, ts_us, n, round(n / 5.0, 9) AS confidence FROM (
SELECT user_id, event_id, ts_us, count(*) OVER (PARTITION BY user_id ORDER BY ts_us RANGE BETWEEN CURRENT ROW AND 43200000000 FOLLOWING)
  - (row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) - rank() OVER (PARTITION BY user_id ORDER BY ts_us)) AS n FROM (SELECT *, epoch_us(ts) AS ts_us FROM events)) WHERE n >= 5"""


@query("burst", _BURST)
def burst(spark: SparkSession, sf: str) -> DataFrame:
    return wn.bursts(_events(spark, sf), "user_id", "ts", "event_id", HALF_DAY).withColumn("confidence", F.round("confidence", 9))


@query(
    "burst_by_identity",
    "SELECT user_id, event_id, ts_us, n FROM (SELECT user_id, event_id, ts_us, count(*) OVER (PARTITION BY user_id ORDER BY ts_us RANGE BETWEEN 43200000000 PRECEDING AND CURRENT ROW) AS n FROM (SELECT *, epoch_us(ts) AS ts_us FROM events)) WHERE n >= 4",
)
def burst_by_identity(spark: SparkSession, sf: str) -> DataFrame:
    return wn.trailing_bursts(_events(spark, sf), "user_id", "ts", "event_id", HALF_DAY, 4)


_GAPS = "g AS (SELECT user_id, event_id, epoch_us(ts) AS ts_us, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap_s FROM events)"


@query(
    "periodic",
    f"""WITH {_GAPS}, p AS (SELECT user_id, count(*) AS n, avg(gap_s) AS mean_s, stddev_pop(gap_s) AS sd, min(ts_us) AS first_us FROM g GROUP BY user_id)
SELECT user_id, n, round(mean_s, 6) AS mean_s, round(sd / mean_s, 9) AS cv, round(1 - sd / mean_s, 9) AS confidence, first_us FROM p WHERE n >= 5 AND mean_s > 0 AND sd / mean_s < 0.9""",
)
def periodic(spark: SparkSession, sf: str) -> DataFrame:
    out = wn.periodic(_events(spark, sf), "user_id", "ts", "event_id", max_cv=0.9)
    return out.select("user_id", "n", F.round("mean_s", 6).alias("mean_s"), F.round("cv", 9).alias("cv"), F.round("confidence", 9).alias("confidence"), "first_us")


_ANOMALY_CTE = f"""{_GAPS}, k AS (SELECT user_id, event_id, gap_s FROM g WHERE gap_s IS NOT NULL),
q AS (SELECT user_id, list(gap_s ORDER BY gap_s) AS l FROM k GROUP BY user_id HAVING count(*) >= 9),
z AS (SELECT user_id, l[len(l) // 4 + 1] AS q1, l[len(l) * 3 // 4 + 1] AS q3 FROM q),
a AS (SELECT user_id, event_id, gap_s, q1, q3, CASE WHEN q3 > q1 THEN abs(gap_s - (q1 + q3) / 2) / (q3 - q1) END AS c FROM k JOIN z USING (user_id) WHERE gap_s < q1 - 1.5 * (q3 - q1) OR gap_s > q3 + 1.5 * (q3 - q1))"""


@query("interval_anomaly", f"WITH {_ANOMALY_CTE} SELECT user_id, event_id, gap_s, q1, q3, round(c, 9) AS confidence FROM a")
def interval_anomaly(spark: SparkSession, sf: str) -> DataFrame:
    return wn.interval_anomalies(_events(spark, sf), "user_id", "ts", "event_id").withColumn("confidence", F.round("confidence", 9))


@query(
    "pattern_detector",
    f"""WITH {_ANOMALY_CTE}, b AS ({_BURST}), p AS (SELECT user_id, count(*) AS n, avg(gap_s) AS mean_s, stddev_pop(gap_s) AS sd, min(ts_us) AS first_us FROM g GROUP BY user_id)
SELECT * FROM (SELECT 'burst' AS pattern, user_id, ts_us AS at_us, confidence FROM b
UNION ALL SELECT 'periodic', user_id, first_us, round(1 - sd / mean_s, 9) FROM p WHERE n >= 5 AND mean_s > 0 AND sd / mean_s < 0.3
UNION ALL SELECT 'anomaly', a.user_id, epoch_us(ts), round(c, 9) FROM a JOIN events USING (event_id)) WHERE confidence >= 0.5""",
)
def pattern_detector(spark: SparkSession, sf: str) -> DataFrame:
    return wn.patterns(_events(spark, sf), "user_id", "ts", "event_id", HALF_DAY).withColumn("confidence", F.round("confidence", 9))


@query(
    "trend",
    """WITH r AS (SELECT o_custkey, o_totalprice AS y, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS DOUBLE) AS i FROM orders),
t AS (SELECT o_custkey, count(y) AS n, regr_slope(y, i) AS slope, CASE WHEN var_pop(y) > 0 THEN regr_r2(y, i) ELSE 0 END AS r2 FROM r GROUP BY o_custkey)
SELECT o_custkey, n, round(slope, 4) AS slope, round(r2, 6) AS r2, CASE WHEN slope > 0.001 THEN 'increasing' WHEN slope < -0.001 THEN 'decreasing' ELSE 'stable' END AS direction FROM t WHERE n >= 3 AND (r2 >= 0.3 OR abs(slope) >= 0.001)""",
)
def trend(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "orders").withColumn("seq", F.struct("o_orderdate", "o_orderkey"))
    return wn.trend(rows, "o_custkey", "o_totalprice", "seq").select("o_custkey", "n", F.round("slope", 4).alias("slope"), F.round("r2", 6).alias("r2"), "direction")


_ACF = """WITH r AS (SELECT event_type, value AS y, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
d AS (SELECT *, y - avg(y) OVER (PARTITION BY event_type) AS d FROM r WHERE n >= 40),
v AS (SELECT event_type, sum(d * d) AS v FROM d GROUP BY event_type),
c AS (SELECT a.event_type, l.lag, sum(a.d * b.d) AS c FROM d a CROSS JOIN (SELECT unnest(range(1, 21)) AS lag) l JOIN d b ON b.event_type = a.event_type AND b.i = a.i + l.lag WHERE l.lag < a.n // 2 GROUP BY ALL),
f AS (SELECT event_type, CAST(lag AS INTEGER) AS lag, CASE WHEN v > 0 THEN c / v ELSE 0 END AS acf FROM c JOIN v USING (event_type))"""


@query("autocorrelation", f"{_ACF} SELECT event_type, lag, round(acf, 9) AS acf FROM f")
def autocorrelation(spark: SparkSession, sf: str) -> DataFrame:
    return wn.autocorrelation(read(spark, sf, "events"), "event_type", "value", "event_id", 20).withColumn("acf", F.round("acf", 9))


@query(
    "periodicity",
    f"""{_ACF}, p AS (SELECT *, lag(acf) OVER w AS b, lead(acf) OVER w AS a FROM f WINDOW w AS (PARTITION BY event_type ORDER BY lag))
SELECT event_type, arg_max(lag, (acf, -lag)) AS period, round(max(acf), 9) AS strength FROM p WHERE acf > b AND acf > a AND acf > 0.01 GROUP BY event_type""",
)
def periodicity(spark: SparkSession, sf: str) -> DataFrame:
    return wn.periodicity(read(spark, sf, "events"), "event_type", "value", "event_id", 20, 0.01).withColumn("strength", F.round("strength", 9))


_ACF_50 = _ACF.replace("range(1, 21)", "range(1, 51)").replace("n >= 40", "n >= 100")


@query("autocorrelation_50", f"{_ACF_50} SELECT event_type, lag, round(acf, 9) AS acf FROM f")
def autocorrelation_50(spark: SparkSession, sf: str) -> DataFrame:
    """With as many lags as the reference takes by default."""
    return wn.autocorrelation(read(spark, sf, "events"), "event_type", "value", "event_id", 50).withColumn("acf", F.round("acf", 9))


@query(
    "periodicity_50",
    f"""{_ACF_50}, p AS (SELECT *, lag(acf) OVER w AS b, lead(acf) OVER w AS a FROM f WINDOW w AS (PARTITION BY event_type ORDER BY lag))
SELECT event_type, arg_max(lag, (acf, -lag)) AS period, round(max(acf), 9) AS strength FROM p WHERE acf > b AND acf > a AND acf > 0.01 GROUP BY event_type""",
)
def periodicity_50(spark: SparkSession, sf: str) -> DataFrame:
    return wn.periodicity(read(spark, sf, "events"), "event_type", "value", "event_id", 50, 0.01).withColumn("strength", F.round("strength", 9))


_HIST = "h AS (SELECT event_type, CAST(greatest(0, least(15, floor(value / 500.0 * 16))) AS INTEGER) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL)"


@query("histogram", f"WITH {_HIST} SELECT event_type, bin, n, round(n / sum(n) OVER (PARTITION BY event_type), 9) AS share FROM h")
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return wn.histogram(read(spark, sf, "events"), "value", 0.0, 500.0, 16, ["event_type"]).withColumn("share", F.round("share", 9))


@query(
    "bimodal",
    f"WITH {_HIST} SELECT event_type, CAST(count_if(p) AS BIGINT) AS peaks, count_if(p) >= 2 AS bimodal FROM (SELECT event_type, n > lag(n) OVER w AND n > lead(n) OVER w AS p FROM h WINDOW w AS (PARTITION BY event_type ORDER BY bin)) GROUP BY event_type",
)
def bimodal(spark: SparkSession, sf: str) -> DataFrame:
    return wn.is_bimodal(wn.histogram(read(spark, sf, "events"), "value", 0.0, 500.0, 16, ["event_type"]), ["event_type"])


@query(
    "bounded_window",
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS a FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS b FROM l WHERE a = 1 AND epoch_us(ts) >= (SELECT max(epoch_us(ts)) FROM events) - 864000000000)
SELECT event_type, user_id, event_id FROM f WHERE b <= 20""",
)
def bounded_window(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    now = F.lit(e.agg(F.max("ts")).first()[0])
    return wn.retain(e, "user_id", "ts", "event_id", now, 864_000, 20, ["event_type"]).select("event_type", "user_id", "event_id")


@query("window_since", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' ORDER BY event_id DESC LIMIT 50")
def window_since(spark: SparkSession, sf: str) -> DataFrame:
    return wn.since(_events(spark, sf), "ts", "event_id", F.lit("2024-01-10").cast("timestamp"), 50).select("event_id")


@query("window_sample")
def window_sample(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    return wn.sample(e, "event_id", 100, processed=e.filter("event_type = 'click'")).select("event_id", "event_type")


@query("unprocessed", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def unprocessed(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    return wn.unprocessed(e, e.filter("event_type = 'purchase'"), "user_id").select("event_id")
