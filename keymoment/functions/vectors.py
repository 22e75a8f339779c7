"""Column functions on vectors (array<float>), computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(values: list[float]) -> Column:
    """A literal vector."""
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column, floor: float = 1e-6) -> Column:
    """The vector over its length; a shorter vector than floor as it is."""
    n = norm(a)
    return F.when(n > floor, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def blend(a: Column, b: Column, wa: float, wb: float) -> Column:
    """The normalised weighted sum of two vectors."""
    return l2_normalize(F.zip_with(a, b, lambda x, y: x.cast("double") * F.lit(wa) + y.cast("double") * F.lit(wb)))
