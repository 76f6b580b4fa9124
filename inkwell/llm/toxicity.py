"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

Training: the labelled texts of a bounded sample (at most max_labelled rows and max_bytes of text, those with the smallest
hashes; the bounds are parameters) give document frequencies of hashed n-grams of characters by class, summed over all tasks
before anything is left out; of the features whose log-count ratio is min_z standard errors from 0, the max_features with
the clearest ratios are the model's, and logistic regression learns one factor for each ratio. That runs in one task, whose
memory the sample's bounds bound; the driver gets weights only. Scoring: one pass over all characters of every text; a
feature counts once a text, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm import common, textkit
from inkwell.llm.neardup import grouped

ORDERS = (4, 5, 6)
BITS = 22
SHARD_BYTES = 2 << 20
#: Tasks that the sample is dealt to; it is bounded, so they are.
SAMPLE_PARTS = 8
MAX_LABELLED = 20_000
MAX_BYTES = 32 << 20
#: Hash values of a slice; a slice is summed by one task.
SLICE = 1 << 16

#: A factor for each place of an n-gram and a summand for each order.
_PLACES = textkit.mixed(np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SALTS = textkit.mixed(np.arange(101, 117, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _folds() -> np.ndarray:
    """Each character of the first plane in lower case, where that is one character; white space is a space."""
    out = np.arange(1 << 16, dtype=np.uint32)
    for k in range(1 << 16):
        if not 0xD800 <= k < 0xE000:
            low = chr(k).lower()
            out[k] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else k
    out[0x09:0x0E] = 0x20
    return out


_FOLD = _folds()


@dataclass
class Model:
    """Weights by hashed n-gram (0: no feature), the bias, and the orders and bits that the hash uses."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    orders: tuple[int, ...] = ORDERS
    bits: int = BITS

    def table(self) -> np.ndarray:
        """Number of the feature of each hash value plus 1; 0 for none."""
        slots = np.zeros(1 << self.bits, dtype=np.int32)
        slots[self.features] = np.arange(1, len(self.features) + 1)
        return slots


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The folded characters of all texts (null: none), and the first of each text (one entry more than texts)."""
    data, offsets = textkit.text_bytes(texts)
    try:
        letters = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        first = offsets if len(letters) == len(data) else np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    except UnicodeDecodeError:
        parts = [data[a:b].tobytes().decode(errors="replace").encode("utf-32-le") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        letters = np.frombuffer(b"".join(parts), dtype=np.uint32)
        first = np.concatenate([[0], np.cumsum([len(x) // 4 for x in parts], dtype=np.int64)])
    return np.where(letters < 1 << 16, _FOLD[letters & 0xFFFF], letters), first


def grams(letters: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each order the hash of the n-gram that begins at each character, but for the last ones."""
    sums = np.zeros(len(letters), dtype=np.uint64)
    wide = letters.astype(np.uint64)
    for k in range(max(orders)):
        sums = sums[: max(0, len(letters) - k)] + wide[k:] * _PLACES[k]
        if k + 1 in orders:
            yield k + 1, (sums + _SALTS[k] >> np.uint64(64 - bits)).astype(np.int32)


def occurring(texts: pa.Array, orders: tuple[int, ...], bits: int, slots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, feature), each once: all hashes, or those that have a slot, as slot numbers."""
    letters, first = characters(texts)
    found = []
    for order, hashes in grams(letters, orders, bits):
        if slots is None:
            at, value = np.arange(len(hashes)), hashes
        else:
            value = slots[hashes]
            at = np.flatnonzero(value)
            value = value[at] - 1
        owner = np.searchsorted(first, at, side="right") - 1
        whole = at + order <= first[owner + 1]
        found.append((owner[whole] << 32) | value[whole].astype(np.int64))
    pairs = textkit.distinct(np.concatenate(found))
    return pairs >> 32, pairs & 0xFFFFFFFF


def fit(
    labelled: DataFrame,
    *,
    text: str = "text",
    label: str = "toxic",
    orders: tuple[int, ...] = ORDERS,
    max_features: int = 40_000,
    min_z: float = 3.5,
    alpha: float = 1.0,
    ridge: float = 1e-3,
    steps: int = 120,
) -> Model:
    """Fit on labelled rows, which are a bounded sample (see sample()).

    Null texts are empty; rows without a label are left out; a label over 0 is a 1. Repeated rows count each time; rows that
    tie for a place in the model are taken by hash. Without rows, or with one class only, every score is the share of the classes
    (0.5 without rows).
    """
    common.small_batches(labelled.sparkSession)
    packed = common.Packed(labelled)
    y = packed.column(label).cast("int")
    rows = packed.docs.select(F.coalesce(packed.column(text), F.lit("")).alias("text"), F.when(y.isNotNull(), (y > 0).cast("int")).alias("y")).filter("y is not null")
    rows = common.written(rows.repartition(SAMPLE_PARTS), "toxic-sample")
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    empty = Model(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32), 0.0 if n0 == n1 else float(np.log((n1 + 1) / (n0 + 1))), orders)
    if not n0 or not n1:
        common.dropped(rows)
        return empty

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), dtype=np.uint32)
        for batch in common.gathered(batches, 0, SHARD_BYTES):
            toxic = np.asarray(batch.column(1)) > 0
            owner, feature = occurring(batch.column(0), orders, BITS)
            for c in (0, 1):
                counts[c] += np.bincount(feature[toxic[owner] == bool(c)], minlength=1 << BITS).astype(np.uint32)
        for part in range((1 << BITS) // SLICE):
            own = np.ascontiguousarray(counts[:, part * SLICE : (part + 1) * SLICE])
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([own.tobytes()], pa.binary())], names=["part", "counts"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["part"]):
            d0, d1 = sum(np.frombuffer(x, dtype=np.uint32).reshape(2, SLICE).astype(np.float64) for x in group.column("counts").to_pylist())
            ratio = np.log((d1 + alpha) / (n1 + 2 * alpha)) - np.log((d0 + alpha) / (n0 + 2 * alpha))
            z = np.abs(ratio) / np.sqrt(1 / (d1 + alpha) + 1 / (d0 + alpha))
            at = np.flatnonzero((z >= min_z) & (d0 + d1 > 0))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(at + group.column("part")[0].as_py() * SLICE), pa.array(ratio[at]), pa.array(z[at])], names=["f", "r", "z"])

    sums = rows.mapInArrow(frequencies, "part bigint, counts binary").repartition("part").sortWithinPartitions("part")
    chosen = sums.mapInArrow(judged, "f bigint, r double, z double").orderBy(F.desc("z"), "f").limit(max_features).select("f", "r").toPandas().sort_values("f")
    features, ratios = chosen["f"].to_numpy(np.int64), chosen["r"].to_numpy(np.float64)
    if not len(features):
        common.dropped(rows)
        return empty
    model = Model(features, ratios.astype(np.float32), 0.0, orders)

    def designs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = model.table()
        for batch in common.gathered(batches, 0, SHARD_BYTES):
            owner, slot = occurring(batch.column(0), orders, BITS, slots)
            ends = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            blobs = [slot[a:b].astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(blobs, pa.binary())], names=["y", "x"])

    def regression(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(y, x) for batch in batches for y, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        got.sort()
        labels = np.array([y for y, _ in got], dtype=np.float64)
        counts = np.array([len(x) // 4 for _, x in got])
        column = np.frombuffer(b"".join(x for _, x in got), dtype=np.int32)
        del got
        factors, bias = regressed(counts, column, ratios, labels, ridge, steps)
        yield pa.RecordBatch.from_arrays([pa.array([(factors * ratios).astype(np.float32).tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])

    made = common.written(rows.mapInArrow(designs, "y int, x binary"), "toxic-designs")
    found = made.coalesce(1).mapInArrow(regression, "weights binary, bias double").first()
    common.dropped(rows, made)
    return Model(features, np.frombuffer(found["weights"], dtype=np.float32), found["bias"], orders)


def regressed(counts: np.ndarray, column: np.ndarray, ratios: np.ndarray, y: np.ndarray, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression on x = ratio of each feature present, by Adam over all rows; classes as they are.

    counts: features of each row; column: their numbers, row after row.
    """
    n, m = len(y), len(ratios)
    # sums by row and, in another order, by column; an entry of its own after the last keeps empty rows and columns at 0
    row_starts = np.concatenate([[0], np.cumsum(counts)])
    by_column = np.argsort(column, kind="stable")
    row_of = np.repeat(np.arange(n, dtype=np.int32), counts)[by_column]
    column_starts = np.concatenate([[0], np.cumsum(np.bincount(column, minlength=m))])
    del by_column

    def summed(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.add.reduceat(np.append(values, 0.0), starts[:-1])
        out[starts[1:] == starts[:-1]] = 0
        return out

    factor, bias = np.zeros(m), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    first, second, b1, b2 = np.zeros(m), np.zeros(m), 0.0, 0.0
    for t in range(1, steps + 1):
        margin = summed((factor * ratios)[column], row_starts) + bias
        miss = 1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y
        slope = summed(miss[row_of], column_starts) * ratios / n + ridge * factor
        slope_b = float(miss.mean())
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        b1, b2 = 0.9 * b1 + 0.1 * slope_b, 0.999 * b2 + 0.001 * slope_b**2
        rate = 0.1 * (1 - t / (steps + 1))
        factor -= rate * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        bias -= rate * b1 / (1 - 0.9**t) / (np.sqrt(b2 / (1 - 0.999**t)) + 1e-8)
    return factor, float(bias)


def sample(labels: DataFrame, docs: DataFrame, *, held_out: Column | None = None, max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_BYTES, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Labelled texts to fit on, as (text, toxic): rows of labels that aren't held out and have a label, at most max_labelled
    of them, and of their documents, in the same order, as many as have max_bytes of text in all.

    Those with the smallest hash of the key are taken. Their keys, bounded by max_labelled, are broadcast, so no text is
    shuffled. Null keys and labels are left out; a key with several labels or texts is taken with each.
    """
    usable = labels.filter(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull())
    if held_out is not None:
        usable = usable.filter(~held_out)
    taken = usable.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).orderBy(F.xxhash64("k"), "k", "y").limit(max_labelled)
    packed = common.Packed(docs)
    own = packed.docs.select(packed.column(key).alias("k"), packed.column(text).alias("text"))
    sizes = own.select("k", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).join(F.broadcast(taken), "k").groupBy("k").agg(F.sum("size").alias("size"))
    before = F.sum("size").over(Window.orderBy(F.xxhash64("k"), "k").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # max_labelled rows at most
    fits = sizes.select("k", before.alias("upto")).filter(F.col("upto") <= max_bytes).select("k")
    keys = common.written(taken.join(F.broadcast(fits), "k"), "toxic-keys")
    return own.join(F.broadcast(keys), "k").select("text", F.col("y").alias("toxic"))


def scored(docs: DataFrame, model: Model, *, text: str = "text", score: str = "score") -> DataFrame:
    """docs and a score from 0 to 1 for each row (higher: label 1 likelier).

    A column called like the score, in whatever case, is replaced; others may have any names. Null and empty texts get the
    score of no features, sigmoid(bias); texts of any length are read whole; each row is scored by itself, repeated rows
    alike. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # at most max_features entries
    packed = common.Packed(docs, without=(score,))
    place = packed.place(text)
    inside = packed.kept.index(place) if place in packed.kept else None
    rows = packed.rows(None if inside is not None else text)

    def score_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        slots = known.table()
        for batch in batches:
            texts = batch.column("row").field(inside) if inside is not None else batch.column("text")
            whole = pa.RecordBatch.from_arrays([texts, batch.column("row")], names=["text", "row"])
            for part in common.by_bytes(whole, 0, SHARD_BYTES):
                owner, slot = occurring(part.column(0), known.orders, known.bits, slots)
                margin = np.bincount(owner, weights=known.weights[slot], minlength=part.num_rows) + known.bias
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(1 / (1 + np.exp(-np.clip(margin, -40, 40))))], names=["row", "score"])

    out = rows.mapInArrow(score_all, packed.schema("score double"))
    return out.select(*packed.columns(), F.col("score").alias(score))


def held_out(key: str = "doc_id") -> Column:
    """Rows that no label is learned from: crc32 of the key as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % 5 == 0, F.lit(False))
