"""Distributed union-find over edges, and the checkpoints it needs."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names; only in local mode, as in tests, a temporary one where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sigloom-ckpt-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there: executors may be lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let the cleaner drop the shuffle files of plans that a checkpoint has cut off.

    It acts when the driver's garbage is collected, which long jobs with a
    large heap may not see for half an hour, while the files fill the disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of an Arrow batch between the JVM and a Python worker, unless the session asks for other than Spark's default.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few megabytes: the default, 10,000 rows or 64 MB, is meant for narrow rows, not for documents.

    Each running task holds a batch in the JVM, on its way and in Python.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("bB") == str(64 << 20):
        spark.conf.set(key, str(BATCH_BYTES))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edges; root is the least node of its component.

    Alternates the large-star and small-star steps: each is one aggregate and
    one join on the same key, rounds grow with the logarithm of the component
    size, and no task ever holds a component. Ends when the edges are stars:
    no node has two roots, and no root has one.
    """
    key = F.col
    cur = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    cur = checkpoint(cur)
    while True:
        both = cur.select("u", "v").unionByName(cur.select(key("v").alias("u"), key("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(key("v").alias("u"), key("m").alias("v")).filter("u != v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(key("v").alias("u"), key("m").alias("v")).unionByName(low.select("u", key("m").alias("v"))).filter("u != v").distinct()
        cur = checkpoint(small)
        ends = cur.select(key("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(cur.select(key("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        open_ = ends.groupBy("n").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).filter("out > 1 or (out > 0 and into > 0)")
        if open_.isEmpty():
            break
    roots = cur.select(key("v").alias("node")).distinct().select("node", key("node").alias("root"))
    return cur.select(key("u").alias("node"), key("v").alias("root")).unionByName(roots)
