"""Fingerprints of images, audio and video held as arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.functions.numbers import col, let


def _hex(bits: np.ndarray) -> str:
    """Four bits a digit, filled up with zeros at the right."""
    padded = np.concatenate([bits, np.zeros(-len(bits) % 4, bits.dtype)]).reshape(-1, 4)
    return "".join("0123456789ABCDEF"[d] for d in padded @ np.array([8, 4, 2, 1]))


def _basis(n: int) -> np.ndarray:
    """Cosine basis, rows by frequency, the first scaled by 1 / sqrt 2."""
    k = np.cos((2 * np.arange(n) + 1)[None, :] * np.arange(n)[:, None] * np.pi / (2 * n))
    k[0] /= np.sqrt(2)
    return k


def dct_hash_of(grid: np.ndarray) -> str:
    """64 hex digits: bits of a 16x16 grid's cosine transform over their upper median, without the constant one."""
    k = _basis(len(grid))
    d = 0.25 * k @ grid @ k.T
    bits = (d > np.sort(d.ravel())[d.size // 2]).T.ravel()[1:]
    return _hex(bits.astype(int))


@F.pandas_udf(T.StringType())
def dct_hash(grid: pd.Series) -> pd.Series:
    return grid.map(lambda g: None if g is None else dct_hash_of(np.array([list(r) for r in g], float)))


def block_hash(grid) -> Column:
    """16 hex digits of an 8x8 grid: values over the upper median, columns of the grid first."""
    def bits(s: Column) -> Column:
        column = lambda y: F.transform(s["g"], lambda r: F.when(F.get(r, y) > s["median"], "1").otherwise("0"))
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(s["g"]) - 1), column)), "")

    def with_median(g: Column) -> Column:
        return let(F.array_sort(F.flatten(g)), lambda v: F.struct(g.alias("g"), F.get(v, F.floor(F.size(v) / 2).cast("int")).alias("median")))

    return bits_to_hex(let(let(col(grid), with_median), bits))


def bits_to_hex(bits) -> Column:
    """Four binary digits a hex digit, the last filled up at the right."""
    def hexed(b: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(b), F.lit(1)), F.lit(4))
        digits = F.transform(starts, lambda i: F.conv(F.rpad(F.substring(b, i, F.lit(4)), 4, "0"), 2, 16))
        return F.when(F.length(b) == 0, "").otherwise(F.array_join(digits, ""))

    return let(col(bits), hexed)


def color_hash(r, g, b) -> Column:
    """32 hex digits of three histograms of equal length."""
    two = lambda v: F.lpad(F.hex(F.floor(v * 255).cast("long").bitwiseAND(F.lit(255))), 2, "0")
    each = F.transform(F.arrays_zip(col(r).alias("r"), col(g).alias("g"), col(b).alias("b")), lambda x: F.concat(two(x["r"]), two(x["g"]), two(x["b"])))
    return F.upper(F.substring(F.sha2(F.array_join(each, ""), 256), 1, 32))


def composite_hash(*hashes) -> Column:
    return F.upper(F.sha2(F.concat_ws("|", *[col(h) for h in hashes]), 256))


def xor_hex(hashes) -> Column:
    """Digit by digit over an array of hex strings, as long as the first."""
    digit = lambda s, i: F.coalesce(F.conv(F.substring(s, i, F.lit(1)), 16, 10).cast("int"), F.lit(0))

    def folded(h: Column) -> Column:
        one = lambda i: F.hex(F.aggregate(h, F.lit(0), lambda a, s: a.bitwiseXOR(digit(s, i))).cast("long"))
        n = F.length(F.get(h, F.lit(0)))
        return F.when(F.size(h) > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), one), "")).otherwise("")

    return let(col(hashes), folded)


def energy_fingerprint(pcm, window: int = 1024) -> Column:
    """Whether the energy rises from window to window, as hex; what fills no window is left out."""
    x = col(pcm)
    k = F.floor(F.size(x) / window).cast("int")
    energy = F.transform(F.when(k > 0, F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0)))).otherwise(F.array().cast("array<int>")), lambda i: F.aggregate(F.slice(x, i * window + 1, F.lit(window)), F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")) / window)
    rises = F.zip_with(F.slice(energy, F.lit(2), F.greatest(k - 1, F.lit(0))), F.slice(energy, F.lit(1), F.greatest(k - 1, F.lit(0))), lambda b, a: F.when(b > a, "1").otherwise("0"))
    return bits_to_hex(F.array_join(rises, ""))


def speech_segments(pcm, rate, threshold: float = 0.01, silence_s: float = 0.3, window_s: float = 0.02) -> Column:
    """array<struct(start, end)> in seconds: stretches of loud windows, ended by enough silence; a fold over the windows."""
    x, r = col(pcm), col(rate)
    w = F.floor(r * window_s).cast("int")
    n = F.size(x)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, w)).otherwise(F.array().cast("array<int>"))
    seg = "array<struct<start:double,end:double>>"
    init = F.struct(F.array().cast(seg).alias("out"), F.lit(-1).alias("start"), F.lit(0).alias("quiet"))

    def step(a: Column, i: Column) -> Column:
        part = F.slice(x, i + 1, w)
        loud = F.sqrt(F.aggregate(part, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")) / F.size(part)) >= threshold
        quiet = F.when(loud, 0).when(a["start"] >= 0, a["quiet"] + w).otherwise(a["quiet"]).cast("int")
        ends = ~loud & (a["start"] >= 0) & (quiet >= F.floor(r * silence_s))
        one = F.struct((a["start"] / r).alias("start"), ((i - quiet) / r).alias("end"))
        return F.struct(
            F.when(ends & (one["end"] > one["start"]), F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"),
            F.when(ends, -1).when(loud & (a["start"] < 0), i).otherwise(a["start"]).cast("int").alias("start"),
            quiet.alias("quiet"),
        )

    return F.aggregate(starts, init, step, lambda a: F.when(a["start"] >= 0, F.concat(a["out"], F.array(F.struct((a["start"] / r).alias("start"), (n / r).alias("end"))))).otherwise(a["out"]))


def scenes_fixed(diffs, threshold: float = 0.3) -> Column:
    d = col(diffs)
    return F.filter(F.transform(d, lambda v, i: F.when(v >= threshold, i)), lambda i: i.isNotNull())


def scenes_adaptive(diffs, window: int = 30, sensitivity: float = 2.0) -> Column:
    """Places that stand out of the ``2 * window`` values around them; after one, half a window is skipped."""
    def stands_out(d: Column, i: Column) -> Column:
        def test(s: Column) -> Column:
            var = F.aggregate(s["part"], F.lit(0.0), lambda a, v: a + (v - s["mean"]) * (v - s["mean"])) / (2 * window)
            return F.get(d, i) > s["mean"] + sensitivity * F.sqrt(var)

        part = F.slice(d, i - window + 1, F.lit(2 * window))
        mean = lambda p: F.struct(p.alias("part"), (F.aggregate(p, F.lit(0.0), lambda a, v: a + v) / (2 * window)).alias("mean"))
        return let(let(part, mean), test)

    def found(d: Column) -> Column:
        n = F.size(d)
        places = F.when(n > 2 * window, F.sequence(F.lit(window), F.greatest(n - window - 1, F.lit(window)))).otherwise(F.array().cast("array<int>"))
        return F.filter(places, lambda i: stands_out(d, i))

    init = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("free"))
    step = lambda a, i: F.struct(F.when(i >= a["free"], F.concat(a["out"], F.array(i))).otherwise(a["out"]).alias("out"), F.when(i >= a["free"], i + window // 2 + 1).otherwise(a["free"]).alias("free"))
    return F.aggregate(let(col(diffs), found), init, step, lambda a: a["out"])


def keyframes_uniform(total, target: int) -> Column:
    t = col(total)
    every = F.sequence(F.lit(0), F.greatest(t - 1, F.lit(0)))
    some = F.transform(F.sequence(F.lit(0), F.lit(max(target - 1, 0))), lambda i: F.floor(i * t / float(max(target, 1))).cast("int"))
    return F.when((t <= 0) | F.lit(target <= 0), F.array().cast("array<int>")).when(F.lit(target) >= t, every.cast("array<int>")).otherwise(some)


def keyframes_novel(diffs, most: int, least: float = 0.1) -> Column:
    """Frame 0, then those that differ enough, then the end; ``most`` in all."""
    d = col(diffs)
    novel = F.filter(F.transform(d, lambda v, i: F.when((i >= 1) & (v >= least), i)), lambda i: i.isNotNull())
    picks = F.slice(F.concat(F.array(F.lit(0)), novel), 1, max(most, 1))
    n = F.size(d)
    return F.when((n > 0) & (F.element_at(picks, -1) != n) & (F.size(picks) < most), F.concat(picks, F.array(n))).otherwise(picks)


def motion_class(diffs) -> Column:
    d = col(diffs)
    avg = F.aggregate(d, F.lit(0.0), lambda a, v: a + v) / F.size(d)
    return F.when((F.size(d) == 0) | (avg < 0.02), "static").when(avg < 0.1, "low").when(avg < 0.3, "medium").otherwise("high")


def color_temperature(colors) -> Column:
    """Warm above 0, cool below; colors array<struct(r, g, b, share)>."""
    c = col(colors)
    total = F.aggregate(c, F.lit(0.0), lambda a, x: a + x["share"])
    warm = F.aggregate(c, F.lit(0.0), lambda a, x: a + (x["r"] - x["b"]) / 255.0 * x["share"])
    return F.when(total > 0, warm / total).otherwise(0.0)


def color_diversity(pixels) -> Column:
    """Distinct colours among about a thousand pixels taken at equal steps."""
    p = col(pixels)
    n = F.size(p)
    step = F.greatest(F.floor(n / 1000).cast("int"), F.lit(1))
    some = F.filter(p, lambda x, i: i % step == 0)
    return F.when(n > 0, F.size(F.array_distinct(some)) / F.least(F.lit(1000), F.floor(n / step))).otherwise(0.0)


def rgb_to_hsl(r, g, b) -> Column:
    """struct(h in degrees, s, l)."""
    x, y, z = (col(c) / 255.0 for c in (r, g, b))
    hi, lo = F.greatest(x, y, z), F.least(x, y, z)
    d, light = hi - lo, (hi + lo) / 2
    s = F.when(d == 0, 0.0).when(light > 0.5, d / (2 - hi - lo)).otherwise(d / (hi + lo))
    h = F.when(d == 0, 0.0).when(hi == x, (y - z) / d + F.when(y < z, 6).otherwise(0)).when(hi == y, (z - x) / d + 2).otherwise((x - y) / d + 4)
    return F.struct((h * 60).alias("h"), s.alias("s"), light.alias("l"))


def rgb_hex(r, g, b) -> Column:
    two = lambda c: F.lpad(F.hex(col(c).cast("long")), 2, "0")
    return F.concat(F.lit("#"), two(r), two(g), two(b))


def dominant_colors_of(pixels: np.ndarray, k: int = 5, most: int = 10_000, rounds: int = 20, seed: int = 42) -> list[tuple[int, int, int, float]]:
    """(r, g, b, share) by k-means on pixels taken at equal steps, greatest share first."""
    if not len(pixels):
        return []
    p = pixels[:: max(1, -(-len(pixels) // most))].astype(float)
    r = np.random.default_rng(seed)
    c = p[r.choice(len(p), min(k, len(p)), replace=False)]
    for _ in range(rounds):
        near = ((p[:, None] - c[None]) ** 2).sum(2).argmin(1)
        new = np.array([p[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
        if np.allclose(new, c):
            break
        c = new
    share = np.bincount(near, minlength=len(c)) / len(p)
    return [(*map(int, c[i]), float(share[i])) for i in np.argsort(-share, kind="stable") if share[i] > 0]


_COLORS = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in "rgb"] + [T.StructField("share", T.DoubleType())]))


@F.pandas_udf(_COLORS)
def dominant_colors(pixels: pd.Series) -> pd.Series:
    def one(p):
        rows = dominant_colors_of(np.array([(x["r"], x["g"], x["b"]) for x in p], float))
        return [{"r": r, "g": g, "b": b, "share": s} for r, g, b, s in rows]

    return pixels.map(lambda p: None if p is None else one(p))
