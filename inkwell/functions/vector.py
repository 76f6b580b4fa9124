"""Vector arithmetic as Column expressions; everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(vector: str | Column) -> Column:
    return F.col(vector) if isinstance(vector, str) else vector


def dot(left: str | Column, right: str | Column) -> Column:
    """Inner product, accumulated in double in list order; null if either side is null."""
    pairs = F.zip_with(_col(left), _col(right), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)


def norm(vector: str | Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(left: str | Column, right: str | Column) -> Column:
    """Divides by both norms, so that unnormalised writers do no harm; null for a zero vector."""
    return dot(left, right) / F.nullif(norm(left) * norm(right), F.lit(0.0))


def cosine_to(vector: str | Column, asked: Sequence[float]) -> Column:
    """Cosine to a fixed query vector, whose norm is folded to a constant."""
    size = sum(x * x for x in asked) ** 0.5
    if size == 0:
        return F.lit(None).cast("double")
    return dot(vector, F.array(*[F.lit(float(x)) for x in asked])) / F.nullif(norm(vector) * F.lit(size), F.lit(0.0))


def l2_normalised(vector: str | Column, unless_length: int | None = None) -> Column:
    """The vector over its norm; one of zeros stays as it is, and so does one of `unless_length` entries (normalised already)."""
    size = F.coalesce(F.nullif(norm(vector), F.lit(0.0)), F.lit(1.0))
    if unless_length is not None:
        size = F.when(F.size(_col(vector)) == unless_length, 1.0).otherwise(size)
    return F.transform(_col(vector), lambda x: x.cast("double") / size)


def truncated(vector: str | Column, dims: int) -> Column:
    """The first dims entries, normalised again."""
    return l2_normalised(F.slice(_col(vector), 1, dims))
