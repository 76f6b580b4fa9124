"""A stored index of vectors for approximate and exact nearest neighbours by cosine.

Vectors are scaled to length 1 and dealt to cells around centroids, trained by k-means on a bounded sample; every vector is
stored, by cell, with its cell's radius in a small table. A search looks for each question only in the `probes` cells whose
centroids are nearest, and ranks what it finds by exact cosines. An exact search then looks, for each question, into the
cells that could still hold something better than its k-th: those whose centroid is nearer than the k-th's distance plus the
cell's radius. On few probes recall is measured (see the tests); exact searches lose nothing.

Questions are taken in blocks; a block and the centroids go to all tasks (both bounded), a task meets the vectors that it
reads with the questions that probe their cell by matrix products, and passes on the k best of each question. A cell with
any share of the vectors is many files, read by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import vector as vectors_

#: Vectors of the training sample for each cell, at most.
SAMPLED = 256
ROUNDS = 12
#: Questions that are asked at once.
BLOCK = 4096
_CENTRE = "cell int, n bigint, radius double, centre array<double>"


def _usable(vector: Column, size: int) -> Column:
    """Vectors of the right length, finite and not of length 0; others have no cosine."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (F.size(vector) == size) & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, size)


def trained(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Unit centroids of at most `cells` cells: spherical k-means from random vectors of the sample."""
    points = np.unique(sample, axis=0)
    chosen = np.random.default_rng(seed).permutation(len(points))[:cells]
    centres = points[chosen]
    for _ in range(rounds):
        best = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, best, points)
        norms = np.linalg.norm(sums, axis=1)
        met = norms > 1e-12
        centres = np.where(met[:, None], sums / np.where(met, norms, 1)[:, None], centres)
    return centres


@dataclass(frozen=True)
class Cells:
    """A stored index: vectors by cell at path/vectors, centroids at path/centres."""

    spark: SparkSession
    path: str
    key: str

    @classmethod
    def built(cls, rows: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", cells: int = 64, seed: int = 1) -> Cells:
        """Store the vectors of rows (key, vector): about sqrt(n) cells suit n vectors.

        The size is that of most vectors of the sample; vectors of another, with nulls, non-finite values or of length 0 are left
        out. Training takes at most SAMPLED vectors for each cell, chosen by a hash of the key; all vectors are stored.
        """
        spark = rows.sparkSession
        light = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
        most = light.filter("v is not null").groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
        size = most["size"] if most else 0
        usable = light.filter(_usable(F.col("v"), size)).withColumn("v", vectors_.l2_normalised("v"))
        # rows with the smallest hashes, a fixed number of them
        drawn = usable.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(SAMPLED * cells).select("v").toArrow()
        centres = trained(_matrix(drawn.column("v").combine_chunks(), size), cells, seed=seed) if drawn.num_rows else np.zeros((0, max(size, 1)))
        kind = light.schema["key"].dataType.simpleString()

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    points = _matrix(batch.column("v"), size)
                    cell = (points @ centres.T).argmax(axis=1)
                    away = np.linalg.norm(points - centres[cell], axis=1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, type=pa.int32()), pa.array(away)], names=["key", "v", "cell", "away"])

        dealt = usable.mapInArrow(placed, f"key {kind}, v array<double>, cell int, away double")
        dealt.hint("rebalance", "cell").write.mode("errorifexists").partitionBy("cell").parquet(f"{path}/vectors")
        index = cls(spark, path.rstrip("/"), key)
        found = {r["cell"]: r for r in index._stored(kind).groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()} if len(centres) else {}
        lines = [(c, found[c]["n"], found[c]["radius"], [float(x) for x in centres[c]]) for c in sorted(found)]
        spark.createDataFrame(lines, _CENTRE).coalesce(1).write.parquet(f"{path}/centres")
        spark.createDataFrame([(key, kind, size)], "key string, kind string, size int").coalesce(1).write.parquet(f"{path}/about")
        return index

    @classmethod
    def opened(cls, spark: SparkSession, path: str) -> Cells:
        return cls(spark, path.rstrip("/"), spark.read.parquet(f"{path}/about").first()["key"])

    def search(self, questions: DataFrame, k: int = 10, probes: int = 8, *, exact: bool = False, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
        """question, rank, <key>, similarity: the k stored vectors with the largest cosines; ties by key.

        Questions are rows (key, vector), keys unique; those without a usable vector have no answers. They are asked in blocks, by ranges of
        a hash of their keys. exact: cells that the probes passed over are read where they could hold something better.
        """
        asked = questions.select(F.col(key).alias("q"), F.col(vector).cast("array<double>").alias("v"))
        about = self.spark.read.parquet(f"{self.path}/about").first()
        asked = asked.filter(_usable(F.col("v"), about["size"])).withColumn("v", vectors_.l2_normalised("v"))
        blocks = max(1, -(-asked.count() // block))
        out = None
        for number in range(blocks):
            part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == number)
            found = self._block(part, k, probes, exact, about["kind"], about["size"])
            out = found if out is None else out.unionByName(found)
        return out

    def cells_of(self, questions: np.ndarray, probes: int) -> np.ndarray:
        """Numbers (rows of the centres table) of the `probes` nearest cells of each question."""
        _, _, centres = self._centres()
        return np.argsort(-(questions @ centres.T), axis=1, kind="stable")[:, :probes]

    def share_read(self, questions: DataFrame, probes: int, key: str = "vec_id", vector: str = "embedding") -> float:
        """The share of the stored vectors that a question is compared with, on average."""
        numbers, counts, _ = self._centres()
        size = self.spark.read.parquet(f"{self.path}/about").first()["size"]
        asked = questions.filter(_usable(F.col(vector).cast("array<double>"), size)).select(vectors_.l2_normalised(F.col(vector).cast("array<double>")).alias("v")).toArrow()
        met = self.cells_of(_matrix(asked.column("v").combine_chunks(), size), probes)
        return float(counts[met].sum(axis=1).mean() / counts.sum())

    # ---- inside ----

    def _stored(self, kind: str) -> DataFrame:
        return self.spark.read.schema(f"key {kind}, v array<double>, away double, cell int").parquet(f"{self.path}/vectors")

    def _centres(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = self.spark.read.schema(_CENTRE).parquet(f"{self.path}/centres").orderBy("cell").collect()
        return np.array([r["cell"] for r in rows], dtype=np.int64), np.array([r["n"] for r in rows], dtype=np.int64), np.array([r["centre"] for r in rows], dtype=np.float64)

    def _block(self, part: DataFrame, k: int, probes: int, exact: bool, kind: str, size: int) -> DataFrame:
        held = part.toArrow()  # a block
        points = _matrix(held.column("v").combine_chunks(), size)
        names = held.column("q").combine_chunks()
        numbers, _, centres = self._centres()
        asks = np.zeros((len(points), len(numbers)), dtype=bool)
        if len(numbers):
            np.put_along_axis(asks, self.cells_of(points, min(probes, len(numbers))), True, axis=1)
        best = self._met(names, points, numbers, asks, k, kind, part)
        if not exact or not len(numbers):
            return self._ranked(best, k)
        radii = np.array([r["radius"] for r in self.spark.read.schema(_CENTRE).parquet(f"{self.path}/centres").orderBy("cell").collect()])
        first = self._ranked(best, k).persist()
        kth = {r["question"]: r["s"] for r in first.filter(F.col("rank") == k).select("question", F.col("similarity").alias("s")).collect()}
        # unit vectors: distance^2 = 2 - 2 * cosine
        reach = np.array([np.sqrt(max(0.0, 2 - 2 * kth[q])) if q in kth else np.inf for q in names.to_pylist()])
        gap = np.sqrt(np.maximum(0, 2 - 2 * points @ centres.T)) - radii[None, :]
        again = (gap <= reach[:, None] + 1e-9) & ~asks
        more = self._met(names, points, numbers, again, k, kind, part)
        both = first.select("question", F.col(self.key).alias("key"), "similarity").unionByName(more)
        return self._ranked(both, k)

    def _met(self, names: pa.Array, points: np.ndarray, numbers: np.ndarray, asks: np.ndarray, k: int, kind: str, part: DataFrame) -> DataFrame:
        """(question, key, similarity): the k best of each task for each question, of the vectors in the cells that it asks."""
        wanted = numbers[asks.any(axis=0)]
        stored = self._stored(kind).filter(F.col("cell").isin([int(c) for c in wanted]))
        at = {int(c): np.flatnonzero(asks[:, n]) for n, c in enumerate(numbers) if asks[:, n].any()}
        size = points.shape[1] if points.ndim == 2 else 0
        asked_kind = part.schema["q"].dataType.simpleString()

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            score, owner, keys = np.zeros(0), np.zeros(0, dtype=np.int64), []

            def cut() -> None:
                """Keep the k best of each question, ties by key."""
                nonlocal score, owner, keys
                column = pa.chunked_array(keys).combine_chunks()
                place = np.asarray(column.to_pandas().rank(method="min", na_option="bottom"))
                order = np.lexsort((place, -score, owner))
                run = owner[order]
                begins = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
                rank = np.arange(len(run)) - np.repeat(begins, np.diff(np.r_[begins, len(run)]))
                kept = order[rank < k]
                score, owner, keys = score[kept], owner[kept], [column.take(pa.array(kept))]

            for batch in batches:
                cell = np.asarray(batch.column("cell"))
                vectors = _matrix(batch.column("v"), size) if batch.num_rows else np.zeros((0, size))
                for c in np.unique(cell):
                    rows, asking = np.flatnonzero(cell == c), at[int(c)]
                    far = np.round(points[asking] @ vectors[rows].T, 12)
                    if far.shape[1] > k:
                        # whatever ties with the k-th stays for now
                        least = np.partition(far, far.shape[1] - k, axis=1)[:, far.shape[1] - k]
                        q, v = np.nonzero(far >= least[:, None])
                    else:
                        q, v = (x.ravel() for x in np.indices(far.shape))
                    score, owner = np.concatenate([score, far[q, v]]), np.concatenate([owner, asking[q]])
                    keys.append(batch.column("key").take(pa.array(rows[v])))
                    if len(score) > 1_000_000:
                        cut()
            if len(score):
                cut()
                yield pa.RecordBatch.from_arrays([names.take(pa.array(owner)), keys[0], pa.array(score)], names=["question", "key", "similarity"])

        return stored.select("key", "v", "cell").mapInArrow(nearest, f"question {asked_kind}, key {kind}, similarity double")

    def _ranked(self, rows: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("question").orderBy(F.desc("similarity"), "key")
        ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return ranked.select("question", "rank", F.col("key").alias(self.key), "similarity")
