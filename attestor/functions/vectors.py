"""Vector expressions over array<double>, in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of value, which is computed once and not for each use of it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return let(a, lambda v: F.sqrt(dot(v, v)))


def _over(a: Column, length: Callable[[Column], Column]) -> Column:
    return let(a, lambda v: let(length(F.sqrt(dot(v, v))), lambda n: F.transform(v, lambda x: x / n)))


def unit(a: Column) -> Column:
    """a over its length, which counts as 1e-12 at least."""
    return _over(a, lambda n: F.greatest(n, F.lit(EPS)))


def unit_row(a: Column) -> Column:
    """As unit, but a vector shorter than 1e-12 stays as it is."""
    return _over(a, lambda n: F.when(n < EPS, 1.0).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    return dot(unit(a), unit(b))


def mean_vector(rows: Column) -> Column:
    """The mean of an array of vectors; null if there are none."""

    def mean(r: Column) -> Column:
        total = F.aggregate(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), F.try_element_at(r, F.lit(1)), lambda s, x: F.zip_with(s, x, lambda p, q: p + q))
        return F.transform(total, lambda x: x / F.size(r))

    return let(rows, mean)


def centroid(rows: Column) -> Column:
    """The unit mean of the unit rows; null if that isn't finite or there are no rows."""
    out = let(unit(mean_vector(F.transform(rows, unit_row))), lambda v: F.when(~F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), v))
    return F.when(F.size(rows) > 0, out)


def clip01(x: Column) -> Column:
    """Within 0 and 1; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
