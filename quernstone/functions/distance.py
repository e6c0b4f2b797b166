"""Vector distances as Column expressions, summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "cosine", "inner_product")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """l2 is the squared Euclidean distance; cosine is 1 - cosine, 1 for a zero vector; inner_product is negated."""
    if metric == "l2":
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    if metric == "cosine":
        norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
        return F.when(norm == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / F.nullif(norm, F.lit(0.0)))
    if metric == "inner_product":
        return -dot(a, b)
    raise ValueError(f"no such metric: {metric}")
