"""Digests of sets of rows that add up: two tables are compared without sorting, shuffling or moving a row.

The digest of some rows is their number and two sums of independent 64-bit hashes of each. It doesn't depend on order or on how
rows are dealt; the digest of a union of parts is the sum of theirs, so appending needs no second read, and rows that go
are subtracted. Rows that differ in one character have other digests but with a chance of 2^-128.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sums of 64-bit numbers: exact for up to 10^19 rows.
WIDE = "decimal(38,0)"
COLUMNS = ("n", "one", "two")


def row_hash(columns: Sequence[str], salt: int) -> Column:
    """64 bits of a row; a null is no value and no neighbour's value."""
    parts = [F.lit(salt)]
    for name in sorted(columns):
        parts += [F.col(f"`{name}`"), F.col(f"`{name}`").isNull()]
    return F.xxhash64(*parts)


def sums(columns: Sequence[str]) -> list[Column]:
    """The aggregates n, one and two over rows of these columns (compared by name, in any order)."""
    return [F.count("*").alias("n"), *[F.sum(row_hash(columns, salt).cast("decimal(28,0)")).cast(WIDE).alias(name) for salt, name in ((1, "one"), (2, "two"))]]


def digests(rows: DataFrame, *by: str, columns: Sequence[str] | None = None) -> DataFrame:
    """n, one, two of the rows for each value of `by` (of all without; then no rows give 0 and nulls). Combined before the shuffle.

    All other columns count unless `columns` names them; a column of maps can't be hashed and must be left out.
    """
    counted = [c for c in rows.columns if c not in by] if columns is None else list(columns)
    return rows.groupBy(*by).agg(*sums(counted))


def added(*parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The digest of all rows of some digests' rows together."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(*by).agg(*[F.sum(c).cast("bigint" if c == "n" else WIDE).alias(c) for c in COLUMNS])


def compared(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
    """by, n_left, n_right and equal for each value that either has: whether the rows are the same ones."""
    a = left.select(*by, F.struct(*COLUMNS).alias("a"))
    b = right.select(*[F.col(c).alias(f"__{c}") for c in by], F.struct(*COLUMNS).alias("b"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    both = a.join(b, same, "full_outer")
    count = lambda side: F.coalesce(F.col(side)["n"], F.lit(0)).alias({"a": "n_left", "b": "n_right"}[side])
    keys = [F.when(F.col("a").isNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in by]
    return both.select(*keys, count("a"), count("b"), F.col("a").eqNullSafe(F.col("b")).alias("equal"))
