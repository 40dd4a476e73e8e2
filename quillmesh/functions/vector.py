"""Vector functions as columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """NaN where a vector is zero; null where one is missing."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(float("nan"))).otherwise(F.try_divide(dot(a, b), scale))


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def reaches(score, least) -> Column:
    """A finite score of at least ``least``; null and NaN do not reach it."""
    s = F.col(score) if isinstance(score, str) else score
    return F.coalesce(~F.isnan(s) & (F.abs(s) < float("inf")) & (s >= least), F.lit(False))
