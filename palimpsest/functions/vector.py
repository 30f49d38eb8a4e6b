"""Distances, statistics and text forms of vectors, as column expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, within [0, 2]; 1 where a vector is null, empty or zero, or lengths differ."""
    length = norm(a) * norm(b)
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b)) & (length > 0)
    return F.when(usable, F.least(F.lit(2.0), F.greatest(F.lit(0.0), 1 - dot(a, b) / length))).otherwise(F.lit(1.0))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def sample_variance(m2: Column, count: Column) -> Column:
    return F.when(count < 2, F.lit(0.0)).otherwise(m2 / (count - 1))


def format_vector(v: Column) -> Column:
    """The text form ``[a,b,...]``."""
    return F.concat(F.lit("["), F.array_join(v.cast("array<string>"), ","), F.lit("]"))


def parse_vector(text: Column) -> Column:
    return F.from_json(text, "array<float>")
