"""Vector functions on array columns; sums are in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigloom.functions.numbers import col

MAX_DOUBLE = 1.7976931348623157e308


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def dot(a, b) -> Column:
    """0 for vectors of different lengths."""
    a, b = col(a), col(b)
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))).otherwise(0.0)


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(col(a), lambda x: x.cast("double") * x.cast("double"))))


def normalize(a) -> Column:
    """Of length one; a zero vector stays as it is."""
    a = col(a)
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(a.cast("array<double>"))


def cosine(a, b) -> Column:
    """0 for different lengths, empty and zero vectors."""
    n = norm(a) * norm(b)
    return F.when((F.size(col(a)) == F.size(col(b))) & (n > 0), dot(a, b) / n).otherwise(0.0)


def euclidean(a, b) -> Column:
    """The greatest double for different lengths."""
    a, b = col(a), col(b)
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.sqrt(_sum(d))).otherwise(MAX_DOUBLE)


def hamming_hex(a, b) -> Column:
    """Differing bits of two hex strings of equal length, 15 digits a step; null for different lengths."""
    a, b = col(a), col(b)
    starts = F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1)), F.lit(15))
    piece = lambda s, i: F.conv(F.substring(s, i, F.lit(15)), 16, 10).cast("long")
    bits = F.transform(starts, lambda i: F.bit_count(F.coalesce(piece(a, i), F.lit(0)).bitwiseXOR(F.coalesce(piece(b, i), F.lit(0)))))
    return F.when(F.length(a) == F.length(b), F.aggregate(bits, F.lit(0), lambda s, v: s + v))


def hamming_similarity(a, b) -> Column:
    return 1.0 - hamming_hex(a, b) / (4.0 * F.length(col(a)))


def char_similarity(a, b) -> Column:
    """Equal characters at equal places over the shorter length; 0 if one is empty."""
    a, b = col(a), col(b)
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)))
    return F.when(n > 0, F.size(same) / n).otherwise(0.0)
