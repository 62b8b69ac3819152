"""Declared pipelines: graphs of named operators that compile to one lazy plan a sink.

A graph is JSON or YAML: nodes (id, operator, config) and edges (source,
target). Operators are functions of a session, their input DataFrames and their
configuration, registered by name with default settings. Unknown operators,
dangling edges and cycles are errors before anything runs.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from graphlib import CycleError, TopologicalSorter
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.functions import shapers as sh
from sigloom.operators import reduce as rd
from sigloom.operators import windows as wn

Operator = Callable[[SparkSession, list[DataFrame], dict[str, Any]], DataFrame]
_OPERATORS: dict[str, tuple[Operator, dict[str, Any], int]] = {}


def operator(name: str, inputs: int = 1, **defaults: Any) -> Callable[[Operator], Operator]:
    """Register an operator; ``inputs`` is the least number of edges into it."""

    def add(fn: Operator) -> Operator:
        _OPERATORS[name] = (fn, defaults, inputs)
        return fn

    return add


def operators() -> dict[str, dict[str, Any]]:
    """Names and default settings."""
    return {k: dict(d) for k, (_, d, _) in sorted(_OPERATORS.items())}


def load(text: str) -> dict:
    """A graph from JSON or YAML text."""
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def order(nodes: list[str], edges: list[tuple[str, str]]) -> list[str]:
    """Sources before targets; nodes without a constraint in the given order. A cycle is an error."""
    sorter: TopologicalSorter = TopologicalSorter({n: [] for n in nodes})
    for a, b in edges:
        sorter.add(b, a)
    sorter.prepare()
    place, out = {n: i for i, n in enumerate(nodes)}, []
    while sorter.is_active():
        for n in sorted(sorter.get_ready(), key=place.__getitem__):
            out.append(n)
            sorter.done(n)
    return out


def problems(spec: dict) -> list[str]:
    """What keeps the graph from being compiled."""
    ids = [n["id"] for n in spec.get("nodes", [])]
    found = [f"node {i} occurs more than once" for i in sorted({i for i in ids if ids.count(i) > 1})]
    found += [f"node {n['id']}: unknown operator {n['operator']}" for n in spec.get("nodes", []) if n["operator"] not in _OPERATORS]
    edges = [tuple(e) for e in spec.get("edges", [])]
    found += [f"edge {a} -> {b}: no node {x}" for a, b in edges for x in (a, b) if x not in ids]
    for n in spec.get("nodes", []):
        have = sum(b == n["id"] for _, b in edges)
        need = _OPERATORS.get(n["operator"], (None, None, 0))[2]
        if have < need:
            found.append(f"node {n['id']}: {n['operator']} needs {need} inputs, has {have}")
    if not found:
        try:
            order(ids, edges)
        except CycleError as e:
            found.append(f"the graph has a cycle: {' -> '.join(e.args[1])}")
    return found


def compile_graph(spark: SparkSession, spec: dict, inputs: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The DataFrame of each node that no edge leaves. Defaults are merged under each node's settings; ``inputs`` replaces nodes."""
    if bad := problems(spec):
        raise ValueError("; ".join(bad))
    nodes = {n["id"]: n for n in spec["nodes"]}
    edges = [tuple(e) for e in spec.get("edges", [])]
    done: dict[str, DataFrame] = dict(inputs or {})
    for i in order(list(nodes), edges):
        if i not in done:
            fn, defaults, _ = _OPERATORS[nodes[i]["operator"]]
            done[i] = fn(spark, [done[a] for a, b in edges if b == i], defaults | nodes[i].get("config", {}))
    leaving = {a for a, _ in edges}
    return {i: done[i] for i in nodes if i not in leaving}


def condition(spec: dict) -> Column:
    """A trigger as a predicate: {"all": [...]}, {"any": [...]}, {"exists": s}, {"equals": [s, v]}, {"score": x} over columns signals and score."""
    (kind, arg), *more = spec.items()
    if more:
        raise ValueError(f"a condition has one kind: {sorted(spec)}")
    if kind in ("all", "any"):
        return (sh.all_of if kind == "all" else sh.any_of)([condition(c) for c in arg])
    if kind == "exists":
        return sh.signal_exists("signals", arg)
    if kind == "equals":
        return sh.signal_equals("signals", *arg)
    if kind == "score":
        return sh.score_at_least("score", arg)
    raise ValueError(f"unknown condition {kind}")


def merged_settings(*layers: dict | None) -> dict:
    """Settings by rising precedence: code defaults, file, overrides; nested tables are merged, lists replaced."""
    out: dict = {}
    for layer in layers:
        for k, v in (layer or {}).items():
            out[k] = merged_settings(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def run_waves(content: DataFrame, waves: list[dict], skip: frozenset[str] = frozenset()) -> DataFrame:
    """Signals of all waves: {"name", "priority", "run": DataFrame -> DataFrame, "when": Column}, the highest priority first.

    A wave sees the rows that its condition lets through; the result is one
    union, its order kept in ``wave_order``.
    """
    out = None
    live = [w for w in sorted(waves, key=lambda w: -w.get("priority", 0)) if w.get("enabled", True) and w["name"] not in skip]
    for k, w in enumerate(live):
        rows = w["run"](content.filter(w["when"]) if w.get("when") is not None else content)
        rows = rows.withColumn("source", F.lit(w["name"])).withColumn("wave_order", F.lit(k))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no wave runs")
    return out


# --- graphs held in tables ----------------------------------------------------------------------


def unknown_manifests(nodes: DataFrame, manifests: DataFrame) -> DataFrame:
    return nodes.join(manifests.select("manifest").distinct(), "manifest", "left_anti").select("id", "manifest")


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, signal, target, missing): edges whose source or target is no node."""
    ids = nodes.select("id").distinct()
    one = lambda end: edges.join(ids, edges[end] == ids["id"], "left_anti").select("source", "signal", "target", F.lit(end).alias("missing"))
    return one("source").unionByName(one("target"))


def unmatched_signals(nodes: DataFrame, edges: DataFrame, emits: DataFrame, accepts: DataFrame) -> DataFrame:
    """(source, signal, target, problem): signals that the source's manifest doesn't emit or the target's doesn't accept; * accepts all.

    emits and accepts: (manifest, signal).
    """
    s = edges.join(nodes.select(F.col("id").alias("source"), F.col("manifest").alias("m")), "source")
    bad_out = s.join(emits.select(F.col("manifest").alias("m"), "signal"), ["m", "signal"], "left_anti").select("source", "signal", "target", F.lit("not emitted").alias("problem"))
    t = edges.join(nodes.select(F.col("id").alias("target"), F.col("manifest").alias("m")), "target")
    open_ = accepts.filter("signal = '*'").select(F.col("manifest").alias("m")).distinct()
    bad_in = t.join(open_, "m", "left_anti").join(accepts.select(F.col("manifest").alias("m"), "signal"), ["m", "signal"], "left_anti").select("source", "signal", "target", F.lit("not accepted").alias("problem"))
    return bad_out.unionByName(bad_in)


def dependencies(emits: DataFrame, requires: DataFrame) -> DataFrame:
    """(consumer, producer, signal): who gets each required signal from whom; of several producers the last by ``seq``.

    emits (component, signal, seq), requires (component, signal).
    """
    e = emits.select(F.col("component").alias("producer"), "signal", "seq")
    r = requires.select(F.col("component").alias("consumer"), "signal")
    met = r.join(e, "signal").filter("consumer <> producer")
    last = F.row_number().over(Window.partitionBy("consumer", "signal").orderBy(F.col("seq").desc()))
    return met.withColumn("rn", last).filter("rn = 1").select("consumer", "producer", "signal")


# --- registered operators ------------------------------------------------------------------------


@operator("table", inputs=0, format="parquet")
def _table(spark, ins, c):
    return spark.read.format(c["format"]).load(c["path"])


@operator("filter", condition="true")
def _filter(spark, ins, c):
    return ins[0].filter(c["condition"])


@operator("select", columns=["*"])
def _select(spark, ins, c):
    return ins[0].selectExpr(*c["columns"])


@operator("clamp", column="value", min=0.0, max=1.0)
def _clamp(spark, ins, c):
    return ins[0].withColumn(c["column"], sh.clamp(c["column"], c["min"], c["max"]))


@operator("attenuvert", column="value", scale=1.0, offset=0.0, clip=True)
def _attenuvert(spark, ins, c):
    return ins[0].withColumn(c["column"], sh.attenuvert(c["column"], c["scale"], c["offset"], c["clip"]))


@operator("quantize", column="value", steps=8, min=0.0, max=1.0)
def _quantize(spark, ins, c):
    return ins[0].withColumn(c["column"], sh.quantize(c["column"], c["steps"], c["min"], c["max"]))


@operator("gate", column="value", op="gte", threshold=0.5)
def _gate(spark, ins, c):
    return ins[0].filter(sh.compare(c["column"], c["op"], c["threshold"]))


@operator("route", column="value", threshold=0.5)
def _route(spark, ins, c):
    return ins[0].withColumn("route", sh.route_threshold(c["column"], c["threshold"]))


@operator("reduce", group="group", value="value", seq="seq", ops=["sum"])
def _reduce(spark, ins, c):
    return rd.reduce_groups(ins[0], c["group"], c["value"], c["ops"], c["seq"])


@operator("top_k", score="score", k=10, seq="seq", descending=True)
def _top_k(spark, ins, c):
    return rd.top_k(ins[0], c["k"], c["score"], c["seq"], c["descending"])


@operator("bursts", by="key", ts="ts", seq="seq", window_s=10.0, least=5)
def _bursts(spark, ins, c):
    return wn.bursts(ins[0], c["by"], c["ts"], c["seq"], c["window_s"], c["least"])


@operator("union", inputs=2)
def _union(spark, ins, c):
    out = ins[0]
    for other in ins[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


@operator("join", inputs=2, on=["key"], how="inner")
def _join(spark, ins, c):
    return ins[0].join(ins[1], c["on"], c["how"])


@operator("write", path="", format="parquet", mode="append")
def _write(spark, ins, c):
    ins[0].write.format(c["format"]).mode(c["mode"]).save(c["path"])
    return ins[0]
