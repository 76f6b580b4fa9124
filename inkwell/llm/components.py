"""Connected components of a table of links; nothing is collected.

Up to ONE_TASK links are joined by one task with disjoint sets; more go through rounds of large and small stars, whose
tables are as wide as the cluster. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import common

#: Links that one task may hold: about 100 bytes each.
ONE_TASK = 1_000_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers in arrays, no Python object for a link: the larger of two joined sets goes to the smaller, all at once."""
    held = [(np.array(batch.column(0), dtype=np.int64), np.array(batch.column(1), dtype=np.int64)) for batch in batches]
    x, y = (np.concatenate([both[k] for both in held] or [np.zeros(0, dtype=np.int64)]) for k in (0, 1))
    held.clear()
    names = np.unique(np.concatenate([x, y]))
    x, y = np.searchsorted(names, x).astype(np.int32), np.searchsorted(names, y).astype(np.int32)
    up = np.arange(len(names), dtype=np.int32)
    while len(x):
        x, y = up[x], up[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(over := up[up], up):
            up = over
    moved = np.flatnonzero(up != np.arange(len(up)))
    for at in range(0, len(moved), 100_000):
        part = moved[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(names[part]), pa.array(names[up[part]])], names=["hi", "lo"])


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Rows (hi, lo) for each vertex hi that isn't the smallest of its component, lo being that; written.

    Each round keeps at most as many edges as there were. Counts are combined before each shuffle and joins on hot
    vertices are split by AQE, so a star of any size is no trouble. Vertices without links don't appear.
    """
    a, b = F.col(left), F.col(right)
    edges = common.written(links.filter(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")), "links")
    if edges.count() <= ONE_TASK:
        out = common.written(edges.coalesce(1).mapInArrow(_joined, "hi bigint, lo bigint"), "components")
        common.dropped(edges)
        return out
    several, edges = edges, common.written(edges.distinct(), "links")
    common.dropped(several)
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = common.written(least.select("hi", F.col("m").alias("lo")).unionByName(small).distinct(), "stars")
        new = _state(after)
        common.dropped(edges)
        edges = after
        if new == state:
            break
        state = new
    return edges
