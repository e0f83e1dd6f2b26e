"""Vector expressions: norms, cosine similarity, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine over the components of ``a``: those that ``b`` lacks are 0, more than ``a`` has are ignored; 0 for a zero norm."""
    b = F.slice(b, F.lit(1), F.size(a))
    dot = _sum(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))))
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot / length)


def score(similarity: Column, digits: int = 1) -> Column:
    """Percent."""
    return F.round(similarity * 100, digits)
