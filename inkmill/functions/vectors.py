"""Vectors as arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """Of length one; a zero vector stays as it is."""
    # the length is bound to a lambda's variable, so that it is worked out once and not for each component
    scaled = lambda size: F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(x.cast("double")))
    return F.when(v.isNotNull(), F.get(F.transform(F.array(norm(v)), scaled), F.lit(0)))
