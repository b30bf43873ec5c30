"""Vector arithmetic as Column expressions; sums run from the first element to the last, in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Metric


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


def normalised(v: Column | str) -> Column:
    """Elements are null where the norm is zero."""
    return F.transform(doubles(v), lambda x: x / F.nullif(norm(v), F.lit(0.0)))


def score(query: Column | str, base: Column | str, metric: Metric, plain_norm: bool = False) -> Column:
    """Higher is nearer. For L2 the query's own norm is left out, as it does not change a ranking; ``plain_norm`` takes the
    base's norm unsquared. A cosine with a zero vector is null."""
    ip = dot(query, base)
    if metric is Metric.IP:
        return ip
    if metric is Metric.L2:
        n = norm(base)
        return 2 * ip - (n if plain_norm else n * n)
    return ip / F.nullif(norm(query) * norm(base), F.lit(0.0))
