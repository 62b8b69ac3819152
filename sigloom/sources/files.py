"""File discovery, incremental ingestion and a content store, on binaryFile and parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.functions import shapers as sh
from sigloom.functions.numbers import col

#: Folders that are never entered.
SKIPPED = ("node_modules", ".git", "bin", "obj")

_MIME = {
    "text/plain": "txt log ini cfg conf",
    "text/markdown": "md markdown",
    "text/html": "html htm",
    "text/css": "css",
    "text/csv": "csv",
    "text/xml": "xml",
    "text/yaml": "yaml yml",
    "text/javascript": "js mjs",
    "text/x-python": "py",
    "text/x-csharp": "cs",
    "text/x-java": "java",
    "text/typescript": "ts tsx",
    "application/json": "json jsonl",
    "application/pdf": "pdf",
    "application/zip": "zip",
    "application/gzip": "gz",
    "application/x-tar": "tar",
    "application/vnd.apache.parquet": "parquet",
    "application/sql": "sql",
    "application/msword": "doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "image/png": "png",
    "image/jpeg": "jpg jpeg",
    "image/gif": "gif",
    "image/webp": "webp",
    "image/svg+xml": "svg",
    "audio/mpeg": "mp3",
    "audio/wav": "wav",
    "audio/ogg": "ogg",
    "video/mp4": "mp4",
    "video/webm": "webm",
    "video/quicktime": "mov",
}
MIME = {ext: kind for kind, exts in _MIME.items() for ext in exts.split()}


def mime_type(path) -> Column:
    """By the extension, in any case; application/octet-stream for others."""
    ext = F.lower(F.regexp_extract(col(path), r"\.([^./\\]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ext), F.lit("application/octet-stream"))


def _relative(path: Column, root: str) -> Column:
    clean = F.regexp_replace(path, "^file:/*", "/")
    return F.regexp_replace(clean, "^" + __import__("re").escape(root.rstrip("/")) + "/?", "")


def discover(spark: SparkSession, root: str, include: list[str] = ("**/*",), exclude: list[str] = (), modified_since: str | None = None, known_hashes: DataFrame | None = None, max_items: int | None = None, recursive: bool = True, min_size: int = 0, max_size: int | None = None) -> DataFrame:
    """(path, name, size, modified, mime, sha256) of the files under a folder, by path.

    Hidden files and the folders in ``SKIPPED`` are left out, and so are empty
    files (Spark's file scans have no split for them). Names and sizes
    decide before any content is read: only what is left is hashed.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if modified_since:
        reader = reader.option("modifiedAfter", modified_since)
    files = reader.load(root)
    rel = _relative(F.col("path"), root)
    name = F.element_at(F.split(rel, "/"), -1)
    hidden = F.exists(F.split(rel, "/"), lambda p: p.startswith(".") | p.isin(*SKIPPED))
    wanted = sh.any_of([sh.glob_match(rel, g) for g in include])
    unwanted = sh.any_of([sh.glob_match(rel, g) for g in exclude])
    files = files.filter(~hidden & wanted & ~unwanted & (F.col("length") >= min_size))
    if max_size is not None:
        files = files.filter(F.col("length") <= max_size)
    out = files.select(rel.alias("path"), name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), mime_type(rel).alias("mime"), F.sha2("content", 256).alias("sha256"))
    if known_hashes is not None:
        out = out.join(known_hashes.select("sha256").distinct(), "sha256", "left_anti").select(*out.columns)
    out = out.orderBy("path")
    return out if max_items is None else out.limit(max_items)


def changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, change): added, changed (another hash), unchanged or removed, against a stored snapshot."""
    b = before.select("path", F.col("sha256").alias("__old"))
    both = now.select("path", "sha256").join(b, "path", "full_outer")
    kind = F.when(F.col("__old").isNull(), "added").when(F.col("sha256").isNull(), "removed").when(F.col("sha256") != F.col("__old"), "changed").otherwise("unchanged")
    return both.select("path", kind.alias("change"))


def storage_path(source, modified, name) -> Column:
    """ingested/ + eight hex digits of the source + / + day + / + file name."""
    return F.concat_ws("/", F.lit("ingested"), F.substring(F.sha2(col(source), 256), 1, 8), F.date_format(col(modified), "yyyyMMdd"), col(name))


STORE = T.StructType([T.StructField("path", T.StringType()), T.StructField("mime", T.StringType()), T.StructField("size", T.LongType()), T.StructField("sha256", T.StringType()), T.StructField("created", T.TimestampType()), T.StructField("content", T.BinaryType()), T.StructField("deleted", T.BooleanType())])


class Store:
    """Contents by path in an append-only parquet table; the last write of a path counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def put(self, rows: DataFrame) -> None:
        """rows: path, mime, content."""
        out = rows.select("path", "mime", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), F.current_timestamp().alias("created"), F.col("content").cast("binary").alias("content"), F.lit(False).alias("deleted"))
        out.write.mode("append").parquet(self.folder)

    def delete(self, paths: list[str]) -> None:
        gone = self.spark.createDataFrame([(p,) for p in paths], "path string")
        none = lambda k: F.lit(None).cast(k)
        gone.select("path", none("string").alias("mime"), none("long").alias("size"), none("string").alias("sha256"), F.current_timestamp().alias("created"), none("binary").alias("content"), F.lit(True).alias("deleted")).write.mode("append").parquet(self.folder)

    def latest(self) -> DataFrame:
        try:
            rows = self.spark.read.schema(STORE).parquet(self.folder)
        except Exception as e:  # nothing was put yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], STORE)
        w = Window.partitionBy("path").orderBy(F.col("created").desc(), F.col("sha256"))
        return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1 and not deleted").drop("__rn", "deleted")

    def list(self, prefix: str = "") -> DataFrame:
        return self.latest().filter(F.col("path").startswith(prefix)).drop("content").orderBy("path")

    def get(self, path: str) -> DataFrame:
        return self.latest().filter(F.col("path") == path)


def ingest(spark: SparkSession, root: str, store: Store, **options) -> DataFrame:
    """Store the new and changed files of a folder; one row (processed, skipped, removed, status)."""
    now = discover(spark, root, **options)
    snapshot = store.list().select("path", "sha256")
    change = changes(now, snapshot).cache()
    todo = change.filter(F.col("change").isin("added", "changed")).select("path")
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    content = content.select(_relative(F.col("path"), root).alias("path"), "content").join(todo, "path").withColumn("mime", mime_type("path"))
    counts = change.groupBy().agg(F.count_if(F.col("change").isin("added", "changed")).alias("processed"), F.count_if(F.col("change") == "unchanged").alias("skipped"), F.count_if(F.col("change") == "removed").alias("removed")).collect()
    store.put(content)
    change.unpersist()
    row = counts[0].asDict()
    return spark.createDataFrame([(row["processed"], row["skipped"], row["removed"], "completed" if row["processed"] or row["skipped"] else "empty")], "processed long, skipped long, removed long, status string")


def file_stream(spark: SparkSession, root: str, schema: T.StructType | str, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """New files of a folder as a stream; its checkpoint remembers what was read."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(root)


def log_signals(df: DataFrame, folder: str) -> None:
    """Append signals to a log table, by day."""
    df.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(folder)


def recent_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    """The last row of each run, newest first."""
    w = Window.partitionBy("run_id").orderBy(F.col("updated_at").desc())
    return runs.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn").orderBy(F.col("started_at").desc()).limit(n)


def cached(keys: DataFrame, cache: DataFrame, now: Column, ttl_s: int = 3600) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached columns, misses): entries (key, ..., at) no older than the time to live."""
    fresh = cache.filter(F.col("at") >= now - F.make_dt_interval(secs=F.lit(ttl_s)))
    w = Window.partitionBy("key").orderBy(F.col("at").desc())
    last = fresh.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
    return keys.join(last, "key"), keys.join(last, "key", "left_anti")
