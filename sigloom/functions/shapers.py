"""Value shaping and routing: pure Column builders. Null means no value; zero is data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from sigloom.functions.numbers import col

#: Differences up to this count as none.
EPS = 1e-4


def clamp(x, lo: float = 0.0, hi: float = 1.0) -> Column:
    # greatest and least skip nulls: guard, so that a missing value stays missing
    return F.when(col(x).isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), col(x))))


def is_limited(x, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.abs(clamp(x, lo, hi) - col(x)) > EPS


def attenuvert(x, scale: float = 1.0, offset: float = 0.0, clip: bool = True) -> Column:
    y = col(x) * scale + offset
    return clamp(y, -1.0, 1.0) if clip else y


_COMPARE = {
    "gt": lambda x, t: x > t,
    "gte": lambda x, t: x >= t,
    "lt": lambda x, t: x < t,
    "lte": lambda x, t: x <= t,
    "eq": lambda x, t: F.abs(x - t) < EPS,
    "ne": lambda x, t: F.abs(x - t) >= EPS,
}


def compare(x, op: str = "gt", threshold: float = 0.5) -> Column:
    if op not in _COMPARE:
        raise ValueError(f"unknown comparison {op}")
    return _COMPARE[op](col(x), F.lit(threshold))


def gate(x, op: str = "gte", threshold: float = 0.5) -> Column:
    """The value where the comparison holds, else null."""
    return F.when(compare(x, op, threshold), col(x))


def quantize(x, steps: int = 8, lo: float = 0.0, hi: float = 1.0) -> Column:
    """The nearest of ``steps`` levels between lo and hi; halves go to the even level."""
    n = max(2, steps)
    level = clamp(F.bround((col(x) - lo) / (hi - lo) * (n - 1)), 0, n - 1)
    return F.lit(lo) + level / (n - 1) * (hi - lo)


def mix(inputs: list, mode: str = "sum") -> Column:
    """sum, max, min or average of the inputs that are there; null if none is."""
    have = F.filter(F.array(*[col(x).cast("double") for x in inputs]), lambda v: v.isNotNull())
    if mode == "max":
        return F.array_max(have)
    if mode == "min":
        return F.array_min(have)
    total = F.when(F.size(have) > 0, F.aggregate(have, F.lit(0.0), lambda a, v: a + v))
    return total / F.size(have) if mode in ("average", "avg") else total


def peak(inputs: list) -> Column:
    """The greatest magnitude among the inputs."""
    return F.array_max(F.transform(F.array(*[col(x).cast("double") for x in inputs]), F.abs))


def switch(control, a, b=0.0) -> Column:
    return F.when(col(control), col(a)).otherwise(col(b) if isinstance(b, (str, Column)) else F.lit(b))


def passed(x, threshold: float = 0.5) -> Column:
    return col(x) >= threshold


def exceeded(x, threshold: float = 0.5) -> Column:
    return col(x) > threshold


def route_threshold(x, threshold: float = 0.5, high: str = "route_high", low: str = "route_low") -> Column:
    return F.when(col(x) >= threshold, high).otherwise(low)


def route_range(x, ranges: list[tuple[str, float, float]], default: str = "route_default") -> Column:
    """The first range, both ends included, that holds the value."""
    out = None
    for name, lo, hi in ranges:
        hit = col(x).between(lo, hi)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def route_match(x, table: dict[str, str], default: str = "route_default") -> Column:
    """By equal text, in any case."""
    pairs = [F.lit(v) for k, r in table.items() for v in (k.lower(), r)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(col(x))), F.lit(default)) if pairs else F.lit(default)


def route_contains(x, table: dict[str, str], default: str = "route_default") -> Column:
    """The first entry whose text occurs in the value, in any case."""
    out = None
    for k, r in table.items():
        hit = F.lower(col(x)).contains(k.lower())
        out = F.when(hit, r) if out is None else out.when(hit, r)
    return F.lit(default) if out is None else out.otherwise(default)


def sample_hold(x, w: WindowSpec) -> Column:
    """The last value that was there, up to and with this row."""
    return F.last(col(x), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def debounce(ts, w: WindowSpec, quiet_ms: float = 100.0) -> Column:
    """True for a row after which nothing follows for the quiet time (so also for the last)."""
    gap = F.lead(_us(ts)).over(w) - _us(ts)
    return F.coalesce(gap >= quiet_ms * 1000, F.lit(True))


def delayed(ts, ms: float = 100.0) -> Column:
    """When the value comes out."""
    return F.timestamp_micros(_us(ts) + F.lit(int(ms * 1000)))


def _us(ts) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def slew(events: Column, rise_ms: float = 1000.0, fall_ms: float = 1000.0) -> Column:
    """Slew limiting of one key: events is an array<struct<us, x>> in order of time; an array of limited values.

    The output starts at the first value and moves towards each next one by at
    most elapsed / rise (or fall).
    """
    start = F.struct(F.lit(None).cast("long").alias("us"), F.lit(None).cast("double").alias("y"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        ms = (e["us"] - acc["us"]) / 1000.0
        gap = e["x"] - acc["y"]
        most = F.when(gap >= 0, ms / rise_ms).otherwise(ms / fall_ms)
        y = F.when(acc["us"].isNull(), e["x"]).otherwise(acc["y"] + F.when(gap >= 0, F.least(gap, most)).otherwise(-F.least(-gap, most)))
        return F.struct(e["us"].alias("us"), y.alias("y"), F.concat(acc["out"], F.array(y)).alias("out"))

    return F.aggregate(events, start, step, lambda acc: acc["out"])


# --- predicates over a map of signals -------------------------------------------------


def signal_exists(signals, name: str) -> Column:
    return F.map_contains_key(col(signals), F.lit(name))


def signal_equals(signals, name: str, value) -> Column:
    """Missing signals don't equal anything."""
    return F.coalesce(F.try_element_at(col(signals), F.lit(name)) == F.lit(value), F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    """True for none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    """False for none."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def completed_at_least(completed, n: int) -> Column:
    return F.size(col(completed)) >= n


def score_at_least(score, threshold: float) -> Column:
    return col(score) >= threshold


# --- fingerprints ----------------------------------------------------------------------


def hashed_value(x) -> Column:
    """First 16 hex digits, upper case, of the SHA-256 of the text."""
    return F.upper(F.substring(F.sha2(col(x).cast("string"), 256), 1, 16))


def safe_score(x) -> Column:
    return F.bround(col(x), 4)


def fingerprint(fields: dict[str, Column | str]) -> Column:
    """16 hex digits of name:value pairs; a null value is the text null, no fields give "default"."""
    if not fields:
        return F.lit("default")
    parts = [F.concat(F.lit(f"{k}:"), F.coalesce(col(v).cast("string"), F.lit("null"))) for k, v in fields.items()]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


TIERS = ["free", "starter", "professional", "enterprise"]


def meets_tier(tier, required: str) -> Column:
    """Unknown tiers rank lowest."""
    rank = F.array_position(F.array(*map(F.lit, TIERS)), F.lower(col(tier)))
    need = TIERS.index(required.lower()) + 1 if required.lower() in TIERS else 1
    return F.greatest(F.coalesce(rank, F.lit(1)), F.lit(1)) >= need


def matches_pattern(name, pattern: str, case: bool = True) -> Column:
    """Exact, ``prefix.*`` or ``*``."""
    n = col(name) if case else F.lower(col(name))
    p = pattern if case else pattern.lower()
    if p == "*":
        return F.lit(True)
    return n.startswith(p[:-1]) if p.endswith("*") else n == p


def glob_match(path, pattern: str) -> Column:
    """``*`` and ``**/*`` match all, ``*.ext`` by ending, ``a**b`` by ordered parts, else exact; in any case."""
    x, p = F.lower(col(path)), pattern.lower()
    if p in ("*", "**", "**/*"):
        return F.lit(True)
    if p.startswith("**/*."):
        p = p[3:]
    if p.startswith("*.") and "*" not in p[1:]:
        return x.endswith(p[1:])
    if "*" in p:
        import re

        parts = [re.escape(s.strip("/*")) for s in p.split("**") if s.strip("/*")]
        return x.rlike(".*".join(parts)) if parts else F.lit(True)
    return x == p
