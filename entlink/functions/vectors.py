"""Vector column expressions.

All are plain Catalyst higher-order functions over ``array<float|double>``
columns, evaluated per row on executors. Arithmetic is done in double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from entlink.functions.util import col as _c


def as_double(v) -> Column:
    return _c(v).cast("array<double>")


def dot(a, b) -> Column:
    """Inner product of two equal-length vectors."""
    prods = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def neg_inner_product(a, b) -> Column:
    return -dot(a, b)


def norm(a) -> Column:
    v = as_double(a)
    return F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


def cosine_distance(a, b) -> Column:
    """1 - a.b / (|a| |b|); NULL when a vector has zero length."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_distance(a, b) -> Column:
    """Euclidean distance."""
    diffs = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(diffs, F.lit(0.0).cast("double"), lambda acc, x: acc + x))


def mean_vectors(a, b) -> Column:
    """C11: element-wise mean of two vectors (mention + one context vector)."""
    return F.zip_with(as_double(a), as_double(b), lambda x, y: (x + y) / 2.0)


def scale(a, divisor) -> Column:
    """A4: vector divided by a scalar (literal frequency weighting)."""
    d = _c(divisor).cast("double")
    return F.transform(as_double(a), lambda x: x / d)


def parse_vector(text) -> Column:
    """``'[0.1, 0.2, ...]'`` text to ``array<double>``."""
    return F.from_json(_c(text), "array<double>")


def vector_to_text(v) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(_c(v), lambda x: x.cast("string")), ","), F.lit("]"))


def round_vector(v, places: int = 4) -> Column:
    return F.transform(as_double(v), lambda x: F.round(x, places))
