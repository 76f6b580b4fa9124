"""Exact k-means on integers, filtered by ball trees.

Each task packs its vectors into trees of at most TREE_ROWS vectors, once. A node stores count, integer sum and radius: an upper
bound of the distance of its vectors from their mean. In a round a tree is walked from its root: where the second nearest
centroid is further from the node's mean than the nearest by more than twice the radius, by the triangle inequality all its
vectors belong to that one, and its sum and count are added as they stand; otherwise its children are looked at, and at
leaves integer distances decide, ties for the smaller number. All comparisons that could be close are made in integers.

Trees are a written table; a round reads it and sends k sums of each task to a sum by (centroid, component); the driver holds
k centroids. What a lost executor had is read again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import common

TREE_ROWS = 4096
LEAF_ROWS = 16
#: Components may be as large as this; squared distances of up to 256 components then fit 64 bits.
LARGEST = 1 << 27
#: Below this largest component, sums of products are exact in floating point.
EXACT = 1 << 21


def integers(df: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = 64, scale: int = 1024) -> DataFrame:
    """key and v of the rows whose vector has exactly `size` components, none null or non-finite: v is floor(scale * x) of each.

    Rows that don't are left out, a null vector too; repeated rows and null keys are rows like others; other columns are left
    out. A component beyond LARGEST is an error when it is met, as distances would not fit 64 bits.
    """
    packed = common.Packed(df)
    x = F.col("x")
    rows = packed.docs.select(packed.column(key).alias("key"), packed.column(vector).cast("array<double>").alias("x")).filter(F.size(x) == size)
    rows = rows.filter(F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf"))))
    large = F.exists(x, lambda y: F.abs(y * float(scale)) >= float(LARGEST))
    checked = F.when(large, F.raise_error(f"a component is beyond {LARGEST / scale}")).otherwise(x)
    return rows.select("key", F.transform(checked, lambda y: F.floor(y * float(scale)).cast("int")).alias("v"))


def starts(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of 'seed:key', in that order; ties by components, null keys last; fewer if there are."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    return [list(r["v"]) for r in vectors.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()]


class Tree:
    """Vectors in leaf order and nodes: first and end row, first child (0: a leaf; the other follows it), radius, integer sum."""

    def __init__(self, points: np.ndarray, nodes: np.ndarray, radius: np.ndarray, sums: np.ndarray):
        self.points, self.nodes, self.radius, self.sums = points, nodes, radius, sums
        self.counts = nodes[:, 1] - nodes[:, 0]
        self.largest = int(np.abs(points).max(initial=0))

    @classmethod
    def built(cls, points: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree of some vectors (at least one), and the order in which they stand in it."""
        order = np.arange(len(points))
        nodes, radius, sums = [[0, len(points), 0]], [], []
        k = 0
        while k < len(nodes):
            begin, end, _ = nodes[k]
            mine = points[order[begin:end]]
            total = mine.sum(axis=0, dtype=np.int64)
            away = mine - total / (end - begin)
            r = float(np.sqrt((away * away).sum(axis=1)).max())
            radius.append(r * (1 + 1e-9))
            sums.append(total)
            if end - begin > LEAF_ROWS and (mine != mine[0]).any():
                # two far ends, and a cut half way along the line between them
                one = mine[int((away * away).sum(axis=1).argmax())].astype(np.float64)
                gap = mine - one
                line = gap[int((gap * gap).sum(axis=1).argmax())]
                along = gap @ line
                half = (end - begin) // 2
                order[begin:end] = order[begin:end][np.argpartition(along, half)]
                nodes[k][2] = len(nodes)
                nodes += [[begin, begin + half, 0], [begin + half, end, 0]]
            k += 1
        return cls(points[order], np.array(nodes, dtype=np.int32), np.array(radius), np.array(sums, dtype=np.int64)), order

    def nearest(self, rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid and squared distance of some vectors, in exact arithmetic; of equal distances the smaller number."""
        points = self.points[rows].astype(np.int64)
        if max(self.largest, int(np.abs(centroids).max(initial=0))) < EXACT:
            x, c = points.astype(np.float64), centroids.astype(np.float64)
            far = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
        else:
            far = np.stack([((points - c) ** 2).sum(axis=1) for c in centroids], axis=1)
        best = far.argmin(axis=1)
        return best, far[np.arange(len(rows)), best].astype(np.int64)

    def walked(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes that belong to one centroid as a whole, that centroid of each, and the rows of leaves that must be looked at."""
        means = self.sums / self.counts[:, None]
        whole, owner, single = [], [], []
        front = np.zeros(1, dtype=np.int64)
        c = centroids.astype(np.float64)
        while len(front):
            away = np.stack([np.sqrt(((means[front] - one) ** 2).sum(axis=1)) for one in c], axis=1)
            best = away.argmin(axis=1)
            first = away[np.arange(len(front)), best]
            away[np.arange(len(front)), best] = np.inf
            second = away.min(axis=1)
            # floating point is off by less than a part in 10^9; ties are never decided here
            with np.errstate(invalid="ignore"):
                sure = second - first > 2 * self.radius[front] + 1e-9 * (first + np.where(np.isinf(second), 0, second)) + 1e-6
            whole.append(front[sure])
            owner.append(best[sure])
            rest = front[~sure]
            child = self.nodes[rest, 2].astype(np.int64)
            single += [np.arange(b, e) for b, e, n in self.nodes[rest] if n == 0]
            child = child[child > 0]
            front = np.concatenate([child, child + 1])
        return np.concatenate(whole), np.concatenate(owner), np.concatenate(single) if single else np.zeros(0, dtype=np.int64)


_TREE = "points binary, nodes binary, radius binary, sums binary"


def trees(vectors: DataFrame, name: str = "trees") -> DataFrame:
    """The written table of trees of (key, v): keys in leaf order, and the tree's arrays."""
    kind = vectors.schema["key"].dataType.simpleString()
    fields = [pa.field(x, pa.binary()) for x in ("points", "nodes", "radius", "sums")]

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, points, held = [], [], 0

        def tree() -> pa.RecordBatch:
            found, order = Tree.built(np.concatenate(points))
            column = pa.chunked_array(keys).combine_chunks().take(pa.array(order))
            lists = pa.ListArray.from_arrays(pa.array([0, len(order)], type=pa.int32()), column)
            arrays = [pa.array([a.tobytes()], type=pa.binary()) for a in (found.points.astype(np.int32), found.nodes, found.radius, found.sums)]
            return pa.RecordBatch.from_arrays([lists, *arrays], schema=pa.schema([pa.field("keys", lists.type), *fields]))

        for whole in batches:
            start = 0
            while start < whole.num_rows:
                part = whole.slice(start, TREE_ROWS - held)
                start += part.num_rows
                held += part.num_rows
                keys.append(part.column(0))
                points.append(np.asarray(part.column(1).flatten(), dtype=np.int32).reshape(part.num_rows, -1))
                if held == TREE_ROWS:
                    yield tree()
                    keys, points, held = [], [], 0
        if held:
            yield tree()

    return common.written(vectors.mapInArrow(grown, f"keys array<{kind}>, {_TREE}"), name)


def _read(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, Tree]]:
    for k in range(batch.num_rows):
        points, nodes, radius, sums = (batch.column(x)[k].as_buffer() for x in ("points", "nodes", "radius", "sums"))
        yield k, Tree(np.frombuffer(points, dtype=np.int32).reshape(-1, size), np.frombuffer(nodes, dtype=np.int32).reshape(-1, 3), np.frombuffer(radius), np.frombuffer(sums, dtype=np.int64).reshape(-1, size))


def sums(planted: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """Count and component sums of the vectors of each centroid that has any."""
    fixed = np.array(centroids, dtype=np.int64)
    k, size = fixed.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, balls, rows = np.zeros((k, size), dtype=np.int64), np.zeros(k, dtype=np.int64), 0, 0
        for batch in batches:
            for _, tree in _read(batch, size):
                whole, owner, single = tree.walked(fixed)
                np.add.at(total, owner, tree.sums[whole])
                np.add.at(count, owner, tree.counts[whole])
                if len(single):
                    best, _ = tree.nearest(single, fixed)
                    np.add.at(total, best, tree.points[single])
                    np.add.at(count, best, 1)
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(met, type=pa.int32()), "n": pa.array(count[met]), "total": pa.array(list(total[met]), type=pa.list_(pa.int64()))})

    by_task = planted.select(*_TREE.replace(" binary", "").split(", ")).mapInArrow(partial, "cluster int, n bigint, total array<bigint>")
    # sums of sums may pass 64 bits
    wide = by_task.select("cluster", F.posexplode(F.concat(F.array("n"), F.col("total"))).alias("place", "x"))
    found = wide.groupBy("cluster", "place").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x")).collect()
    out: dict[int, list[int]] = {}
    for r in found:
        out.setdefault(r["cluster"], [0] * (size + 1))[r["place"]] = int(r["x"])
    return {c: (x[0], x[1:]) for c, x in out.items()}


def moved(planted: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: of each the componentwise floor(sum / count) of its vectors; without any it stays."""
    found = sums(planted, centroids)
    return [[x // found[c][0] for x in found[c][1]] if c in found else old for c, old in enumerate(centroids)]


def assigned(planted: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """key, cluster, distance (squared) of every vector of the trees; balls that are sure ask for one distance a vector."""
    fixed = np.array(centroids, dtype=np.int64)
    size = fixed.shape[1]
    kind = planted.schema["keys"].dataType.elementType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, tree in _read(batch, size):
                whole, owner, single = tree.walked(fixed)
                cluster, distance = np.empty(len(tree.points), dtype=np.int32), np.empty(len(tree.points), dtype=np.int64)
                for node, one in zip(whole, owner, strict=True):
                    begin, end = tree.nodes[node, :2]
                    cluster[begin:end] = one
                    distance[begin:end] = ((tree.points[begin:end].astype(np.int64) - fixed[one]) ** 2).sum(axis=1)
                if len(single):
                    cluster[single], distance[single] = tree.nearest(single, fixed)
                yield pa.RecordBatch.from_arrays([batch.column("keys")[k].values, pa.array(cluster), pa.array(distance)], names=["key", "cluster", "distance"])

    return planted.mapInArrow(found, f"key {kind}, cluster int, distance bigint")


def clustered(df: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, key: str = "vec_id", vector: str = "embedding", size: int = 64, scale: int = 1024) -> DataFrame:
    """vec_id (under the key's name), cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector.

    Kept rows and errors: integers(); repeated rows count each, and null keys too, though neither starts a cluster before others
    (see starts()). With fewer kept vectors than k there are as many clusters; an empty table gives no rows. A sum of
    distances that passes 64 bits is an error.
    """
    vectors = integers(df, key, vector, size, scale)
    centroids = starts(vectors, k, seed)
    if not centroids:
        none = vectors.filter("false").select(F.col("key").alias(key))
        return none.select(key, *[F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string"))])
    planted = trees(vectors)
    for _ in range(rounds):
        after = moved(planted, centroids)
        if after == centroids:
            break  # every further round would give the same
        centroids = after
    found = common.written(assigned(planted, centroids), "clusters")
    common.dropped(planted)
    inertia = {r["cluster"]: int(r["x"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("x")).collect()}
    if sum(inertia.values()) >= 1 << 63:
        raise OverflowError("the sum of the distances passes 64 bits")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    by = F.element_at(F.array(*[F.struct(F.lit(inertia.get(c, 0)).cast("bigint").alias("inertia"), F.lit(d).alias("digest")) for c, d in enumerate(digests)]), F.col("cluster") + 1)
    return found.select(F.col("key").alias(key), "cluster", "distance", by["inertia"].alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("bigint").alias("inertia"), by["digest"].alias("centroid_sha256"))


def sql(k: int = 8, rounds: int = 10, seed: int = 3, table: str = "embeddings", key: str = "vec_id", vector: str = "embedding", size: int = 64, scale: int = 1024) -> str:
    """The same as plain SQL (DuckDB): every round a common table, every vector against every centroid. For keys without ties."""
    nearest = """select {key}, v, cluster, distance from (
  select p.{key}, p.v, c.cluster, list_sum(list_transform(range(1, {end}), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i])))::bigint as distance,
         row_number() over (partition by p.{key} order by distance, c.cluster) as place
  from p, c{n} c) where place = 1"""
    fill = {"key": key, "end": size + 1}
    steps = [
        f"p as materialized (select {key}, list_transform({vector}, lambda x: floor({scale} * x::double)::bigint) as v from {table} "
        f"where len({vector}) = {size} and len(list_filter({vector}, lambda x: x is not null and isfinite(x))) = {size})",
        f"c0 as materialized (select (row_number() over (order by h) - 1)::int as cluster, v from (select v, sha256('{seed}:' || {key}) as h from p order by h limit {k}))",
    ]
    for n in range(rounds):
        steps += [
            f"a{n} as materialized ({nearest.format(n=n, **fill)})",
            f"m{n} as materialized (select cluster, list(((s - (((s % n) + n) % n)) // n)::bigint order by i) as v from (select cluster, i, sum(v[i])::hugeint as s, count(*)::hugeint as n from a{n}, range(1, {size + 1}) t(i) group by cluster, i) group by cluster)",
            f"c{n + 1} as materialized (select c.cluster, coalesce(m.v, c.v) as v from c{n} c left join m{n} m using (cluster))",
        ]
    steps.append(f"a as materialized ({nearest.format(n=rounds, **fill)})")
    return "with " + ",\n".join(steps) + f"""
select a.{key}, a.cluster, a.distance, sum(a.distance) over (partition by a.cluster)::bigint as cluster_inertia, sum(a.distance) over ()::bigint as inertia,
       sha256(array_to_string(c.v, ',')) as centroid_sha256
from a join c{rounds} c using (cluster)"""
