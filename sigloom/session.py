"""Session settings shared by tests, bench and examples."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "sigloom", cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A UTC session with adaptive execution.

    Master, memory and numbers of partitions are those of spark-submit or Spark's
    own; only if ``cpus`` is given (tests, bench) does the session run locally on
    as many cores, with as many shuffle partitions or those given.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    )
    if cpus:
        builder = (
            builder.master(f"local[{cpus}]")
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
            .config("spark.driver.memory", os.environ.get("SIGLOOM_DRIVER_MEMORY", "6g"))
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
        )
    elif shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def read(spark: SparkSession, sf_dir: str, table: str):
    """A driver table by name."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder that the session names in spark.checkpoint.dir; a temporary one only in local mode where none is set."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sigloom-ckpt-"))
    return df.checkpoint(eager=True)
