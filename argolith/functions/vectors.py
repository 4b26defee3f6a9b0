"""Products of sparse (map of term to number) and dense (array) vectors; sums of whole numbers are exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def sparse_dot(a: Column, b: Column) -> Column:
    common = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return F.aggregate(common, F.lit(0.0), lambda s, w: s + a[w].cast("double") * b[w].cast("double"))


def as_sparse(a: Column) -> Column:
    """A dense vector as a map from places."""
    return F.map_from_arrays(F.transform(a, lambda _, i: i.cast("string")), F.transform(a, lambda x: x.cast("double")))
