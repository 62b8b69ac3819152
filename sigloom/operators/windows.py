"""Keyed windows in batch form: retention, sampling, statistics and patterns of events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.operators.reduce import with_running_total


def us(ts: Column | str) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def retain(df: DataFrame, key: str, ts: str, seq: str, now: Column, max_age_s: float, max_items: int, partition: list[str] = ()) -> DataFrame:
    """What a bounded window holds at ``now``: the last entry of each key, not too old, the newest ``max_items``."""
    w = Window.partitionBy(*partition, key).orderBy(F.col(ts).desc(), F.col(seq).desc())
    latest = df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
    fresh = latest.filter(us(ts) >= us(now) - int(max_age_s * 1e6))
    if partition:
        w = Window.partitionBy(*partition).orderBy(F.col(ts).desc(), F.col(seq).desc())
        return fresh.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= max_items).drop("__rn")
    return fresh.orderBy(F.col(ts).desc(), F.col(seq).desc()).limit(max_items)


def since(df: DataFrame, ts: str, seq: str, start: Column, last: int) -> DataFrame:
    """Of the entries from ``start`` on, the last ones."""
    return df.filter(us(ts) >= us(start)).orderBy(F.col(seq).desc()).limit(last)


def sample(df: DataFrame, key: str, n: int, seed: int = 42, processed: DataFrame | None = None) -> DataFrame:
    """n entries by hash of key and seed (all, if there are no more); without those of ``processed``."""
    rest = df.join(processed.select(key).distinct(), key, "left_anti") if processed is not None else df
    return rest.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), key).limit(n)


def window_stats(df: DataFrame, by: str, ts: str) -> DataFrame:
    """Count, oldest, newest, span in seconds and rate a minute (0 for no span)."""
    t = us(ts)
    span = (F.max(t) - F.min(t)) / 1e6
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(t).alias("oldest_us"),
        F.max(t).alias("newest_us"),
        span.alias("span_s"),
        F.when(span > 0, F.count(F.lit(1)) / (span / 60)).otherwise(0.0).alias("per_minute"),
    )


def bursts(df: DataFrame, by: str, ts: str, seq: str, window_s: float = 10.0, least: int = 5) -> DataFrame:
    """(by, seq, ts_us, n, confidence): entries with ``least`` or more, themselves included, within the window that they begin.

    The RANGE frame takes earlier peers of tied times too; they are subtracted.
    """
    t = us(ts)
    frame = Window.partitionBy(by).orderBy("ts_us").rangeBetween(0, int(window_s * 1e6))
    order = Window.partitionBy(by).orderBy("ts_us", seq)
    peers = F.row_number().over(order) - F.rank().over(Window.partitionBy(by).orderBy("ts_us"))
    out = df.select(by, seq, t.alias("ts_us")).withColumn("n", F.count(F.lit(1)).over(frame) - peers)
    return out.filter(F.col("n") >= least).withColumn("confidence", F.col("n") / least)


def trailing_bursts(df: DataFrame, by: str, ts: str, seq: str, window_s: float = 30.0, least: int = 10) -> DataFrame:
    """Entries at which their identity has reached ``least`` in the window that ends there (an assumption: the original detector's source isn't public here)."""
    frame = Window.partitionBy(by).orderBy("ts_us").rangeBetween(-int(window_s * 1e6), 0)
    return df.select(by, seq, us(ts).alias("ts_us")).withColumn("n", F.count(F.lit(1)).over(frame)).filter(F.col("n") >= least)


def _intervals(df: DataFrame, by: str, ts: str, seq: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy("ts_us", seq)
    return df.select(by, seq, us(ts).alias("ts_us")).withColumn("gap_s", (F.col("ts_us") - F.lag("ts_us").over(w)) / 1e6)


def periodic(df: DataFrame, by: str, ts: str, seq: str, max_cv: float = 0.3, least: int = 5) -> DataFrame:
    """(by, n, mean_s, cv, confidence, first_us): keys whose gaps vary little."""
    per = _intervals(df, by, ts, seq).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("gap_s").alias("mean_s"), F.stddev_pop("gap_s").alias("sd"), F.min("ts_us").alias("first_us"))
    per = per.filter((F.col("n") >= least) & (F.col("mean_s") > 0)).withColumn("cv", F.col("sd") / F.col("mean_s"))
    return per.filter(F.col("cv") < max_cv).withColumn("confidence", 1 - F.col("cv")).select(by, "n", "mean_s", "cv", "confidence", "first_us")


def interval_anomalies(df: DataFrame, by: str, ts: str, seq: str, least: int = 10, factor: float = 1.5) -> DataFrame:
    """(by, seq, gap_s, q1, q3, confidence): gaps beyond the quartiles, which are taken by index, not interpolated.

    n entries have n - 1 gaps; the quartiles are the gaps at n // 4 and 3n // 4
    of those, where n counts the gaps. With no spread the confidence is null.
    """
    gaps = _intervals(df, by, ts, seq).filter("gap_s is not null")
    sorted_ = F.array_sort(F.collect_list("gap_s"))
    quart = gaps.groupBy(by).agg(F.count(F.lit(1)).alias("m"), sorted_.alias("g")).filter(F.col("m") >= least - 1)
    quart = quart.select(by, F.get("g", F.floor(F.col("m") / 4).cast("int")).alias("q1"), F.get("g", F.floor(F.col("m") * 3 / 4).cast("int")).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    out = gaps.join(quart, by).filter((F.col("gap_s") < F.col("q1") - factor * iqr) | (F.col("gap_s") > F.col("q3") + factor * iqr))
    return out.select(by, seq, "gap_s", "q1", "q3", F.when(iqr > 0, F.abs(F.col("gap_s") - (F.col("q1") + F.col("q3")) / 2) / iqr).alias("confidence"))


def patterns(df: DataFrame, by: str, ts: str, seq: str, window_s: float = 10.0, least: int = 5, max_cv: float = 0.3, min_confidence: float = 0.5) -> DataFrame:
    """(pattern, by, at_us, confidence) of all detectors that are confident enough."""
    a = bursts(df, by, ts, seq, window_s, least).select(F.lit("burst").alias("pattern"), by, F.col("ts_us").alias("at_us"), "confidence")
    b = periodic(df, by, ts, seq, max_cv).select(F.lit("periodic").alias("pattern"), by, F.col("first_us").alias("at_us"), "confidence")
    times = df.select(by, seq, us(ts).alias("at_us"))
    c = interval_anomalies(df, by, ts, seq).join(times, [by, seq]).select(F.lit("anomaly").alias("pattern"), by, "at_us", "confidence")
    return a.unionByName(b).unionByName(c).filter(F.col("confidence") >= min_confidence)


def trend(df: DataFrame, by: str, y: str, seq: str) -> DataFrame:
    """(by, n, slope, r2, direction): least squares on the index; keys of three values or more; weak trends are left out."""
    i = F.row_number().over(Window.partitionBy(by).orderBy(seq)) - 1
    rows = df.select(by, F.col(y).cast("double").alias("y"), i.cast("double").alias("i"))
    per = rows.groupBy(by).agg(F.count("y").alias("n"), F.regr_slope("y", "i").alias("slope"), F.when(F.var_pop("y") > 0, F.regr_r2("y", "i")).otherwise(0.0).alias("r2"))
    per = per.filter((F.col("n") >= 3) & ((F.col("r2") >= 0.3) | (F.abs("slope") >= 0.001)))
    return per.withColumn("direction", F.when(F.col("slope") > 0.001, "increasing").when(F.col("slope") < -0.001, "decreasing").otherwise("stable"))


def autocorrelation(df: DataFrame, by: str, y: str, seq: str, max_lag: int = 50) -> DataFrame:
    """(by, lag, acf): lags 1 to max_lag below half the length, for keys of 2 * max_lag values or more.

    Values are numbered in two stages, by ranges of the numeric order column and
    within them, and cut into blocks of the number; each block has the values of
    the max_lag places after it too, so a task sums the products of its blocks.
    """
    rows = df.select(by, F.col(y).cast("double").alias("y"), F.col(seq).alias("seq"))
    facts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.min("seq").alias("lo"), F.max("seq").alias("hi")).filter(F.col("n") >= 2 * max_lag)
    share = (F.col("seq") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))
    facts = facts.withColumnRenamed(by, "__key")
    placed = rows.join(F.broadcast(facts), F.col(by).eqNullSafe(F.col("__key"))).select(by, "seq", (F.col("y") - F.col("mean")).alias("d"), F.floor(share * _RANGES).cast("int").alias("range"))
    sums = placed.groupBy(by, "range").agg(F.count(F.lit(1)).alias("c"))
    start = F.coalesce(F.sum("c").over(Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col(by).alias("__by"), F.col("range").alias("__range"), start.alias("start"))
    inside = placed.withColumn("i", F.row_number().over(Window.partitionBy(by, "range").orderBy("seq")) - 1)
    inside = inside.join(F.broadcast(starts), F.col(by).eqNullSafe(F.col("__by")) & (F.col("range") == F.col("__range")))
    numbered = inside.select(by, "d", (F.col("i") + F.col("start")).alias("i"))
    block = F.floor(F.col("i") / _BLOCK)
    halo = F.when((F.col("i") % _BLOCK < max_lag) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    cut = numbered.filter("d is not null").select(by, "d", "i", F.explode(halo).alias("block"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf["i"].to_numpy() - int(pdf["block"].iloc[0]) * _BLOCK
        d, there = np.zeros(_BLOCK + max_lag), np.zeros(_BLOCK + max_lag, bool)
        d[at], there[at] = pdf["d"].to_numpy(float), True
        met = [bool((there[:_BLOCK] & there[lag : lag + _BLOCK]).any()) for lag in range(max_lag + 1)]
        c = np.array([d[:_BLOCK] @ d[lag : lag + _BLOCK] for lag in range(max_lag + 1)])
        # NaN would come out as null
        out = pd.DataFrame({by: [pdf[by].iloc[0]] * len(c), "lag": np.arange(len(c), dtype="int32"), "c": np.nan_to_num(c, posinf=np.inf, neginf=-np.inf), "nan": np.isnan(c)})
        return out[met]

    kind = df.select(by).schema[0].dataType.simpleString()
    per = cut.groupBy(by, "block").applyInPandas(run, f"`{by}` {kind}, lag int, c double, nan boolean")
    per = per.groupBy(by, "lag").agg(F.when(F.max("nan"), F.lit(float("nan"))).otherwise(F.sum("c")).alias("c"))
    var = per.filter("lag = 0").select(F.col(by).alias("__by"), F.col("c").alias("v"))
    out = per.filter("lag > 0").join(F.broadcast(var), F.col(by).eqNullSafe(F.col("__by"))).join(F.broadcast(facts.select("__key", "n")), F.col(by).eqNullSafe(F.col("__key")))
    return out.filter(F.col("lag") < F.floor(F.col("n") / 2)).select(by, "lag", F.when(F.col("v") > 0, F.col("c") / F.col("v")).otherwise(0.0).alias("acf"))


#: Values of a block, and ranges of a key's order column.
_BLOCK, _RANGES = 1 << 16, 1024


def periodicity(df: DataFrame, by: str, y: str, seq: str, max_lag: int = 50, least: float = 0.2) -> DataFrame:
    """(by, period, strength): the highest peak of the autocorrelation above both neighbours."""
    acf = autocorrelation(df, by, y, seq, max_lag)
    w = Window.partitionBy(by).orderBy("lag")
    peaks = acf.withColumn("before", F.lag("acf").over(w)).withColumn("after", F.lead("acf").over(w))
    peaks = peaks.filter((F.col("acf") > F.col("before")) & (F.col("acf") > F.col("after")) & (F.col("acf") > least))
    return peaks.groupBy(by).agg(F.max_by("lag", F.struct(F.col("acf"), -F.col("lag"))).alias("period"), F.max("acf").alias("strength"))


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int = 16, by: list[str] = ()) -> DataFrame:
    """(by, bin, n, share): values of [lo, hi) in equal bins, ends clamped."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(value) - lo) / (hi - lo) * bins))).cast("int")
    per = df.filter(F.col(value).isNotNull()).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1)))  # bins only: a small table
    return per.withColumn("share", F.col("n") / total)


def is_bimodal(hist: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, peaks, bimodal): strict interior maxima of the bins."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy("bin")
    peak = (F.col("n") > F.lag("n").over(w)) & (F.col("n") > F.lead("n").over(w))
    out = hist.withColumn("p", peak).groupBy(*by).agg(F.count_if("p").alias("peaks"))
    return out.withColumn("bimodal", F.col("peaks") >= 2)


def unprocessed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key).distinct(), key, "left_anti")


def time_series(df: DataFrame, ts: str, value: str, start: str, end: str, bucket_s: int) -> DataFrame:
    """(bucket_us, n, total): tumbling buckets aligned to ``start``; empty ones are there with 0."""
    lo, step = us(F.lit(start).cast("timestamp")), bucket_s * 1_000_000
    hi = us(F.lit(end).cast("timestamp"))
    rows = df.select(us(ts).alias("t"), F.col(value).alias("v")).filter((F.col("t") >= lo) & (F.col("t") < hi))
    per = rows.groupBy((lo + F.floor((F.col("t") - lo) / step) * step).alias("bucket_us")).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    spine = df.sparkSession.range(1).select(F.explode(F.sequence(lo, hi - 1, F.lit(step))).alias("bucket_us"))
    return spine.join(per, "bucket_us", "left").select("bucket_us", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


def dashboard_summary(df: DataFrame, start: Column, window_s: float, kinds: dict[str, str], ts: str, value: str) -> DataFrame:
    """(facet, name, n, avg_value, per_second): counts by each facet and in all, of one scan by grouping sets."""
    rows = df.filter(us(ts) >= us(start))
    cols = list(kinds.values())
    view = rows.groupingSets([[F.col(c)] for c in cols] + [[]], *[F.col(c) for c in cols]).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(value), F.lit(0.0)).alias("avg_value"), F.grouping_id(*[F.col(c) for c in cols]).alias("g"))
    full = (1 << len(cols)) - 1
    facet, name = F.lit("all"), F.lit("all")
    for i, (label, c) in enumerate(kinds.items()):
        here = F.col("g") == (full ^ (1 << (len(cols) - 1 - i)))
        facet, name = F.when(here, label).otherwise(facet), F.when(here, F.col(c).cast("string")).otherwise(name)
    return view.select(facet.alias("facet"), name.alias("name"), "n", "avg_value", (F.col("n") / window_s).alias("per_second"))


def distinct_values(df: DataFrame, c: str, seq: str, limit: int = 100) -> DataFrame:
    """(value, first_seq) in order of first sight."""
    return df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.min(seq).alias("first_seq")).orderBy("first_seq").limit(limit)


def event_page(df: DataFrame, where: list[Column], seq: str, offset: int, limit: int, page_first: bool = False) -> DataFrame:
    """A page of the events that meet all conditions, newest first; ``page_first`` pages in insertion order and then sorts."""
    for c in where:
        df = df.filter(c)
    order = F.col(seq).asc() if page_first else F.col(seq).desc()
    page = df.orderBy(order).offset(offset).limit(limit)
    return page.orderBy(F.col(seq).desc())


def meter(df: DataFrame, ts: str, units: Column, limit: float, window_s: int = 60, by: list[str] = ()) -> DataFrame:
    """(by, second, used, percent, throttle, level) for each second with work: the sum over the window that ends there.

    The throttle is 1 up to 80 % and falls to 0 at 100 %; the level is the
    highest of 80, 90, 100 reached (0 below). Sums run within blocks of the
    window's length: no row's frame is summed anew, and no key is one task's work.
    """
    second = F.floor(us(ts) / 1_000_000).cast("long")
    per = df.groupBy(*by, second.alias("second")).agg(F.sum(units).alias("units"))
    # blocks as long as the window: it is the block up to the second, and the block before from its place on
    block, place = F.floor(F.col("second") / window_s).cast("long"), F.pmod("second", F.lit(window_s))
    own = per.select(*by, "second", "units", block.alias("block"), place.alias("place"), F.lit(True).alias("own"))
    both = own.unionByName(own.select(*by, "second", "units", (F.col("block") + 1).alias("block"), "place", F.lit(False).alias("own")))
    w = Window.partitionBy(*by, "block").rowsBetween(Window.unboundedPreceding, 0)
    here = F.sum(F.when(F.col("own"), F.col("units"))).over(w.orderBy("place", F.col("own").desc()))
    before = F.sum(F.when(~F.col("own"), F.col("units"))).over(w.orderBy(F.col("place").desc(), F.col("own").desc()))
    both = both.withColumn("here", here).withColumn("before", before).filter("own")
    per = both.select(*by, "second", F.coalesce(F.col("here") + F.col("before"), "here", "before").alias("used"))
    pct = F.col("used") / limit * 100
    throttle = F.when(pct <= 80, 1.0).when(pct >= 100, 0.0).otherwise((100 - pct) / 20)
    return per.withColumn("percent", pct).withColumn("throttle", throttle).withColumn("level", F.when(pct >= 100, 100).when(pct >= 90, 90).when(pct >= 80, 80).otherwise(0))


def running_count(df: DataFrame, seq: str) -> DataFrame:
    return with_running_total(df, seq, F.lit(1), "running")
