"""Sources, converters, streaming and declared pipelines."""

import io
import os
import subprocess
import sys
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from sigloom import pipeline as pl
from sigloom.operators import windows as wn
from sigloom.sources import convert as cv
from sigloom.sources import files as fl
from sigloom.streaming import windows as sw

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    for name, text in {"a.txt": "alpha", "sub/b.md": "# Title\n\ntext", "sub/.hidden": "x", "node_modules/c.js": "x", "other.bin": "x", "empty.txt": ""}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(root)


def test_discovery(spark, folder):
    got = {r.path: r for r in fl.discover(spark, folder).collect()}
    assert set(got) == {"a.txt", "sub/b.md", "other.bin"}
    assert got["a.txt"].mime == "text/plain" and got["a.txt"].size == 5 and got["other.bin"].mime == "application/octet-stream"
    assert [r.path for r in fl.discover(spark, folder, ["*.md"]).collect()] == ["sub/b.md"]
    assert [r.path for r in fl.discover(spark, folder, exclude=["*.md"], min_size=2).collect()] == ["a.txt"]
    known = spark.createDataFrame([(got["a.txt"].sha256,)], "sha256 string")
    assert [r.path for r in fl.discover(spark, folder, known_hashes=known, max_items=1).collect()] == ["other.bin"]


def test_incremental_ingestion(spark, folder, tmp_path):
    store = fl.Store(spark, str(tmp_path / "store"))
    assert store.list().count() == 0
    assert tuple(fl.ingest(spark, folder, store).first()) == (3, 0, 0, "completed")
    assert tuple(fl.ingest(spark, folder, store).first()) == (0, 3, 0, "completed")
    time.sleep(0.01)
    with open(f"{folder}/a.txt", "w") as f:
        f.write("changed")
    assert tuple(fl.ingest(spark, folder, store).first()) == (1, 2, 0, "completed")
    assert bytes(store.get("a.txt").first().content) == b"changed"
    store.delete(["a.txt"])
    assert {r.path for r in store.list().collect()} == {"sub/b.md", "other.bin"}
    assert {r.path for r in store.list("sub/").collect()} == {"sub/b.md"}


def test_cache_with_time_to_live(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    cache = spark.createDataFrame([("a", 1, 3000), ("a", 2, 3500), ("b", 3, 10)], "key string, v int, s long").select("key", "v", F.timestamp_seconds("s").alias("at"))
    hit, miss = fl.cached(keys, cache, F.timestamp_seconds(F.lit(4000)), 1000)
    assert [(r.key, r.v) for r in hit.collect()] == [("a", 2)] and {r.key for r in miss.collect()} == {"b", "c"}


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_docx_chain(spark):
    p = lambda t, s="": f'<w:p><w:pPr>{f"""<w:pStyle w:val="{s}"/>""" if s else ""}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    body = p("Big", "Heading2") + p("plain") + p("item", "ListParagraph") + f"<w:tbl><w:tr><w:tc>{p('a|b')}</w:tc><w:tc>{p('c')}</w:tc></w:tr><w:tr><w:tc>{p('d')}</w:tc></w:tr></w:tbl>"
    df = spark.createDataFrame([(1, docx(body)), (2, b"no zip"), (3, None)], "id int, content binary")
    got = {r.id: r.content for r in df.withColumn("content", cv.docx_markdown("content")).collect()}
    assert got == {1: "## Big\n\nplain\n\n- item\n\n| a\\|b | c |\n| --- | --- |\n| d |  |", 2: None, 3: None}
    word = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
    assert cv.convert(df, word, "text/markdown", "text/plain").first().content.startswith("Big")
    with pytest.raises(ValueError):
        cv.convert(df, word, "image/png")


def test_graph_problems_and_order():
    ok = {"nodes": [{"id": "a", "operator": "table"}, {"id": "b", "operator": "clamp"}], "edges": [["a", "b"]]}
    assert pl.problems(ok) == [] and pl.order(["b", "a"], [("a", "b")]) == ["a", "b"]
    assert "unknown operator" in pl.problems({"nodes": [{"id": "a", "operator": "nope"}]})[0]
    assert any("no node c" in p for p in pl.problems(ok | {"edges": [["a", "b"], ["b", "c"]]}))
    assert any("needs 1" in p for p in pl.problems({"nodes": ok["nodes"]}))
    cycle = {"nodes": [{"id": "a", "operator": "clamp"}, {"id": "b", "operator": "clamp"}], "edges": [["a", "b"], ["b", "a"]]}
    assert "cycle" in pl.problems(cycle)[0]
    with pytest.raises(ValueError):
        pl.compile_graph(None, cycle)


def test_yaml_graph_runs_with_defaults(spark):
    spec = pl.load("nodes:\n- {id: in, operator: table, config: {path: x}}\n- {id: g, operator: gate, config: {column: v}}\nedges: [[in, g]]\n")
    df = spark.createDataFrame([(0.2,), (0.7,)], "v double")
    assert [r.v for r in pl.compile_graph(spark, spec, {"in": df})["g"].collect()] == [0.7]


def test_conditions_settings_and_waves(spark):
    df = spark.createDataFrame([({"a": "1"}, 0.9), ({}, 0.1)], "signals map<string,string>, score double")
    c = pl.condition({"all": [{"any": [{"equals": ["a", "1"]}, {"exists": "b"}]}, {"score": 0.5}]})
    assert [r[0] for r in df.select(c).collect()] == [True, False]
    assert pl.merged_settings({"a": {"x": 1, "y": 2}}, None, {"a": {"y": 3}}) == {"a": {"x": 1, "y": 3}}
    wave = lambda n, p, **k: {"name": n, "priority": p, "run": lambda d: d.select(F.lit(n).alias("key"), "score"), **k}
    out = pl.run_waves(df, [wave("low", 1), wave("high", 9, when=F.col("score") > 0.5), wave("off", 5, enabled=False)])
    assert sorted((r.source, r.wave_order) for r in out.collect()) == [("high", 0), ("low", 1), ("low", 1)]


def test_unmatched_signals(spark):
    nodes = spark.createDataFrame([("n1", "m1"), ("n2", "m2"), ("n3", "m3")], "id string, manifest string")
    edges = spark.createDataFrame([("n1", "s", "n2"), ("n1", "t", "n2"), ("n1", "s", "n3")], "source string, signal string, target string")
    emits, accepts = spark.createDataFrame([("m1", "s")], "manifest string, signal string"), spark.createDataFrame([("m2", "*"), ("m3", "x")], "manifest string, signal string")
    assert sorted((r.signal, r.target, r.problem) for r in pl.unmatched_signals(nodes, edges, emits, accepts).collect()) == [("s", "n3", "not accepted"), ("t", "n2", "not emitted")]


@pytest.fixture
def stream_dir(spark, tmp_path):
    """events in several files, the later ones first."""
    e = spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id").limit(300)
    path = str(tmp_path / "events")
    e.repartition(4, "user_id").write.parquet(path)
    return path, spark.read.parquet(path)


def test_streams_equal_batch(spark, stream_dir, tmp_path):
    path, batch = stream_dir
    stream = lambda: sw.with_time(fl.file_stream(spark, path, batch.schema, files_per_trigger=2), late="3650 days")
    got = sw.drain(sw.bucket_counts(stream(), "ts", "value", "6 hours", ["event_type"]), "buckets", "complete")
    want = batch.groupBy(F.window(F.col("ts").cast("timestamp"), "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.unix_micros("w.start").alias("s"), "event_type", "n")
    assert sorted((r.start_us, r.event_type, r.n) for r in got.collect()) == sorted(map(tuple, want.collect()))
    once = sw.drain(sw.once(stream(), "user_id"), "once", checkpoint=str(tmp_path / "c1"))
    assert once.count() == batch.select("user_id").distinct().count()


def test_stateful_streams(spark, stream_dir, tmp_path):
    path, batch = stream_dir
    live = fl.file_stream(spark, path, batch.schema, files_per_trigger=100)
    got = sw.drain(sw.slew(live, "user_id", "ts", "value", 3_600_000, 1_800_000), "slewed", checkpoint=str(tmp_path / "c2"))
    from sigloom.functions.shapers import slew

    e = F.array_sort(F.collect_list(F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").alias("x"))))
    want = batch.groupBy("user_id").agg(e.alias("e")).select(F.explode(slew(F.col("e"), 3_600_000, 1_800_000)).alias("y"))
    assert sorted(round(r.y, 6) for r in got.collect()) == sorted(round(r.y, 6) for r in want.collect())
    win = sw.drain(sw.keyed_window(fl.file_stream(spark, path, batch.schema), "event_type", "user_id", "ts", 5, 1e9), "kept", "update", checkpoint=str(tmp_path / "c3"))
    assert all(r.n <= 5 for r in win.collect()) and win.count() >= batch.select("event_type").distinct().count()


def test_alerts_rearm(spark, tmp_path):
    rows = [(1, 50.0), (2, 85.0), (3, 95.0), (4, 92.0), (5, 70.0), (6, 100.0)]
    src = str(tmp_path / "m")
    spark.createDataFrame(rows, "end_us long, percent double").coalesce(1).write.parquet(src)
    out = str(tmp_path / "alerts")
    sw.threshold_alerts(fl.file_stream(spark, src, "end_us long, percent double"), out, str(tmp_path / "c")).start().awaitTermination()
    assert [(r.end_us, r.level) for r in spark.read.parquet(out).orderBy("end_us").collect()] == [(2, 80), (3, 90), (6, 100)]


def test_library_works_without_the_corpus_package(tmp_path):
    """The entry file imports and registers the other queries with the folder and the pipeline gone."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    subprocess.run(["cp", "-r", f"{root}/sigloom", f"{root}/__spark_entry__.py", f"{copy}"] if copy.mkdir() else ["cp", "-r", f"{root}/sigloom", f"{root}/__spark_entry__.py", str(copy)], check=True)
    subprocess.run(["rm", "-rf", str(copy / "sigloom/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)})


def test_dependencies_of_the_whole_table(spark):
    from sigloom import catalog

    users = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").cast("string").alias("signal"), "event_type").distinct()
    met = users.groupBy("signal").agg(F.count("*").alias("n")).filter("n > 1").select("signal")
    got = catalog.queries()["dependency_graph_all"](spark, SF)
    assert {r.signal for r in got.select("signal").distinct().collect()} == {r.signal for r in met.collect()}


def test_time_series_and_lags_reach_the_end(spark):
    from sigloom import catalog

    q = catalog.queries()
    assert q["time_series_all"](spark, SF).agg(F.sum("n")).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()
    assert q["autocorrelation_50"](spark, "/root/testdata/sf0.01").agg(F.max("lag")).first()[0] == 50
