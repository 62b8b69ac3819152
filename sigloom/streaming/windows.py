"""Structured Streaming forms: keyed windows, shapers with state, meters and bucketed counts.

Event time takes the place of the wall clock, and a watermark says how late an
event may be; with ``availableNow`` each gives what its batch form gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def with_time(events: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def bucket_counts(events: DataFrame, ts: str, value: str, bucket: str, by: list[str] = (), start: str | None = None) -> DataFrame:
    """(start_us, by, n, total) of tumbling buckets; ``start`` shifts their grid."""
    w = F.window(ts, bucket, bucket, start) if start else F.window(ts, bucket)
    out = events.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.unix_micros("w.start").alias("start_us"), *by, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str) -> DataFrame:
    out = events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


def meter(events: DataFrame, ts: str, units: Column, limit: float, window: str = "60 seconds", step: str = "1 second") -> DataFrame:
    """(end_us, used, percent, throttle) of the sliding windows."""
    out = events.groupBy(F.window(ts, window, step).alias("w")).agg(F.sum(units).alias("used"))
    pct = F.col("used") / limit * 100
    return out.select(F.unix_micros("w.end").alias("end_us"), "used", pct.alias("percent"), F.when(pct <= 80, 1.0).when(pct >= 100, 0.0).otherwise((100 - pct) / 20).alias("throttle"))


def once(events: DataFrame, key: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return events.dropDuplicatesWithinWatermark([key])


def keyed_window(events: DataFrame, by: str, key: str, ts: str, max_items: int = 100, max_age_s: float = 600.0) -> DataFrame:
    """(by, n, oldest_us, newest_us) after each batch: a bounded and aged window a group, where an entry's return moves it to the end."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entries = dict(zip(*state.get)) if state.exists else {}
        for pdf in batches:
            for name, us in zip(pdf["__key"], pdf["__us"]):
                if entries.get(name, -1) <= us:
                    entries.pop(name, None)
                    entries[name] = int(us)
        rows = sorted(entries.items(), key=lambda e: e[1])
        newest = rows[-1][1]
        rows = [e for e in rows if e[1] >= newest - max_age_s * 1e6][-max_items:]
        state.update(([e[0] for e in rows], [e[1] for e in rows]))
        yield pd.DataFrame({by: [k[0]], "n": [len(rows)], "oldest_us": [rows[0][1]], "newest_us": [newest]})

    rows = events.select(F.col(by).cast("string").alias(by), F.col(key).cast("string").alias("__key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("__us"))
    return rows.groupBy(by).applyInPandasWithState(step, f"{by} string, n long, oldest_us long, newest_us long", "keys array<string>, us array<long>", "update", GroupStateTimeout.NoTimeout)


def slew(events: DataFrame, key: str, ts: str, value: str, rise_ms: float = 1000.0, fall_ms: float = 1000.0) -> DataFrame:
    """(key, us, y): each key's slew-limited values; within a batch in order of time."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        us0, y = state.get if state.exists else (None, None)
        pdf = pd.concat(list(batches)).sort_values("__us", kind="stable")
        out = []
        for us, x in zip(pdf["__us"], pdf["__x"]):
            if us0 is None:
                y = float(x)
            else:
                ms, gap = (us - us0) / 1000.0, x - y
                y += min(gap, ms / rise_ms) if gap >= 0 else -min(-gap, ms / fall_ms)
            us0 = int(us)
            out.append((k[0], us0, float(y)))
        state.update((us0, float(y)))
        yield pd.DataFrame(out, columns=[key, "us", "y"])

    rows = events.filter(F.col(value).isNotNull()).select(F.col(key).cast("string").alias(key), F.unix_micros(F.col(ts).cast("timestamp")).alias("__us"), F.col(value).cast("double").alias("__x"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} string, us long, y double", "us long, y double", "append", GroupStateTimeout.NoTimeout)


def threshold_alerts(metered: DataFrame, folder: str, checkpoint: str, levels: tuple[int, ...] = (80, 90, 100)):
    """Append an alert for each level that a batch of meter rows reaches and the rows before it hadn't; armed again below the lowest.

    The alerts' own table is the state, so a restart goes on where it was.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.orderBy("end_us").select("end_us", "percent").collect()  # one batch of window ends
        try:
            last = spark.read.parquet(folder).orderBy(F.col("end_us").desc()).limit(1).collect()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            last = []
        armed = last[0]["level"] if last else 0
        out = []
        for r in rows:
            reached = max((x for x in levels if r["percent"] >= x), default=0)
            if r["percent"] < levels[0]:
                armed = 0
            elif reached > armed:
                out.append((r["end_us"], reached, r["percent"]))
                armed = reached
        if out:
            spark.createDataFrame(out, "end_us long, level int, percent double").write.mode("append").parquet(folder)

    return metered.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True)


def drain(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run what is there through the stream and read the result from memory (for tests and small jobs)."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
