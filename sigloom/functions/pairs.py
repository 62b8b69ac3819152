"""Similarities of two texts that no built-in expression can say, over Arrow batches.

As folds over characters in an expression they took milliseconds a pair: each
step of a lambda computes the texts it looks at anew.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells of a matrix of pairs x characters; longer texts go in fewer pairs at once.
CELLS = 1 << 18


def _matrix(texts: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a row a text, and lengths; beyond its end a row holds ``fill``."""
    size = np.array([len(t) for t in texts])
    out = np.full((len(texts), int(size.max(initial=0))), fill, np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, size


def _jaro_block(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro similarity of pairs of texts that aren't empty: character by character of all first texts at once."""
    (s, n), (t, m) = _matrix(a, 0xFFFFFFFE), _matrix(b, 0xFFFFFFFF)
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    most, rows = int(reach.max()), np.arange(len(a))
    place = np.arange(t.shape[1])
    used, hit = np.zeros(t.shape, bool), np.zeros(s.shape, bool)
    for i in range(s.shape[1]):
        lo, hi = max(0, i - most), min(t.shape[1], i + most + 1)
        if lo >= hi:
            break
        free = (t[:, lo:hi] == s[:, i, None]) & ~used[:, lo:hi] & (np.abs(place[lo:hi] - i) <= reach[:, None])
        first = free.argmax(1)
        hit[:, i] = found = free[rows, first]
        used[rows[found], lo + first[found]] = True
    k = hit.sum(1).astype(float)
    moved = np.bincount(np.nonzero(hit)[0], s[hit] != t[used], len(a)) // 2
    return np.divide(k / n + k / m + np.divide(k - moved, k, out=np.zeros_like(k), where=k > 0), 3.0)


def _levenshtein_block(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distances of pairs of texts: row by row of all tables at once."""
    (s, n), (t, m) = _matrix(a, 0xFFFFFFFE), _matrix(b, 0xFFFFFFFF)
    place = np.arange(t.shape[1] + 1)
    d = np.broadcast_to(place, (len(a), len(place)))
    for i in range(s.shape[1]):
        # a deletion or a change, then any number of insertions to the right
        new = np.concatenate([d[:, :1] + 1, np.minimum(d[:, 1:] + 1, d[:, :-1] + (t != s[:, i, None]))], 1)
        new = np.minimum.accumulate(new - place, 1) + place
        d = np.where((i < n)[:, None], new, d)
    return d[np.arange(len(a)), m]


def _of_unequal(a: pd.Series, b: pd.Series, block) -> np.ndarray:
    """1 for equal texts, 0 if one of them is empty, NaN if one is null; the others' by ``block``, the shortest first, so many at once as fit."""
    out = np.full(len(a), np.nan)
    s, t = a.to_numpy(object), b.to_numpy(object)
    longest = np.zeros(len(a), np.int64)
    for i, (x, y) in enumerate(zip(s, t)):
        if x is None or y is None:
            continue
        if x == y or not x or not y:
            out[i] = float(x == y)
        else:
            longest[i] = max(len(x), len(y))
    order = np.argsort(longest, kind="stable")
    order, begin = order[longest[order] > 0], 0
    while begin < len(order):
        n = np.arange(1, len(order) - begin + 1) * longest[order[begin:]]
        some = order[begin : begin + max(1, int(np.searchsorted(n, CELLS, "right")))]
        out[some] = block(list(s[some]), list(t[some]))
        begin += len(some)
    return out


def _jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_of_unequal(a, b, _jaro_block))


def _combined_block(a: list[str], b: list[str]) -> np.ndarray:
    prefix = np.array([next((i for i, (x, y) in enumerate(zip(s[:4], t[:4])) if x != y), min(4, len(s), len(t))) for s, t in zip(a, b)])
    j = _jaro_block(a, b)
    longer = np.array([max(len(s), len(t)) for s, t in zip(a, b)])
    edits = 1.0 - _levenshtein_block(a, b) / longer
    mixed = 0.5 * (j + prefix * 0.1 * (1.0 - j)) + 0.3 * edits + 0.2 * np.array([_gram_cosine(s, t, 2) for s, t in zip(a, b)])
    return np.where([s in t or t in s for s, t in zip(a, b)], 0.9, mixed)


def _combined(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_of_unequal(a, b, _combined_block))


def _gram_cosine(x: str, y: str, n: int) -> float:
    p, q = (Counter(t[i : i + n] for i in range(len(t) - n + 1)) for t in (x, y))
    square = sum(c * c for c in p.values()) * sum(c * c for c in q.values())
    return sum(c * q[g] for g, c in p.items() if g in q) / math.sqrt(square) if square else 0.0


def _cosine(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([math.nan if x is None or y is None else _gram_cosine(x, y, k) for x, y, k in zip(a, b, n)], dtype=float)


# wrapped when asked for, not on import
def jaro(s: Column, t: Column) -> Column:
    """Jaro similarity as the texts stand; null if one is null."""
    return F.pandas_udf(_jaro, "double")(s, t)


def gram_cosine(s: Column, t: Column, n: int) -> Column:
    """Cosine of counts of n-grams of characters as the texts stand; 0 without any, null if one is null."""
    return F.pandas_udf(_cosine, "double")(s, t, F.lit(n))


def combined(s: Column, t: Column) -> Column:
    """1 if equal, 0 if one is empty, .9 if one holds the other, else .5 Jaro-Winkler + .3 Levenshtein + .2 bigram cosine, as the texts stand; null if one is null."""
    return F.pandas_udf(_combined, "double")(s, t)
