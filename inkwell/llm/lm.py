"""Language-model scores by a weighted backoff automaton.

States are the n-grams of the training texts, up to `order` words, each named by a hash that the words alone decide; so no
state waits for another's number and every step is spread over ranges of hashes. A name has NAME_BITS bits besides the number
of its range, so the chance that a look-up meets another n-gram's name, under 10 ** -7, is the same at every size. Training is one pass: a task counts
its own n-grams of all orders first (sorting, no Python object per token) and deals sorted, packed counts by (order, range);
one task adds up a range and writes it as a sorted array. Nothing is joined or put together afterwards.

Weights come from counts by Bayesian smoothing. At a state h with count c(h) the arc of a word w weighs
    P(w | h) = (c(h w) + m * P(w | h')) / (c(h) + m)
where h' is the longest proper suffix of h; a word without an arc follows the failure arc, which weighs m / (c(h) + m), to h'. As each
word of a text but its end is followed by a token, the arcs of a state sum to one with what the failure arc leaves over.
Unknown words are one class at the state without words; its probability is the share of words seen once (Good-Turing).

Scoring takes texts in passes of about PASS_BYTES. The states that a pass can meet - the n-grams in its texts - are looked up
in the ranges, each of which is read once a pass, in order, and become an automaton in memory: arc weights, failure weights and
failure links, by number. Then all texts of the pass are walked from left to right at once, token place by token place: each
carries its state, follows failure arcs until the word has an arc, adds up what it passes and goes on from where the arc
leads: the longest suffix that is a state.

A pass holds one range at a time; ranges on a mounted path are mapped, others are read for the pass and dropped. Counts are
64-bit; ranges grow in number with the input, not in size. What is stored are counts: an arc's weight follows from three of
them, and storing it would need the n-grams joined to their contexts and suffixes, twice their size on disk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm import artifacts, common, textkit
from inkwell.llm.neardup import grouped

SHARD_BYTES = 4 << 20
#: Text of a pass of scoring; its n-grams are held by one task.
PASS_BYTES = 8 << 20
#: Bytes of training text for each range of hashed n-grams; a range is added up by one task.
RANGE_BYTES = 32 << 20
NAME_BITS = 48
#: n-grams of one order that a task gathers before it deals them.
KEEP_KEYS = 3 << 20
BLOB_KEYS = 1 << 17
ORDER = 3
#: m by order: how many observations the shorter context counts for.
SMOOTHING = (0.0, 5.0, 3.0, 2.0, 2.0)
END = np.uint64(0x5851F42D4C957F2D)
#: Counts from here on stand in a list of their own beside the array of bytes.
MANY = 255

_PLACES = textkit.mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def held_out(key: str = "doc_id") -> Column:
    """Rows that the model doesn't learn from: crc32 of the key as text, modulo 5, is 1."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % 5 == 1, F.lit(False))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and one end after them; the first token of each text (one entry more than texts)."""
    words, first = textkit.hashed_words(texts, textkit.VISIBLE)
    n = len(first) - 1
    out = np.full(len(words) + n, END, dtype=np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(first))] = words
    return out, first + np.arange(n + 1)


def states(hashes: np.ndarray, first: np.ndarray, order: int, range_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the names of the n-grams that end at each token, and whether one does (not across texts).

    The highest bits are the number of the range, NAME_BITS follow, the rest is 0.
    """
    unused = np.uint64(max(0, 64 - NAME_BITS - range_bits))
    place = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))
    sums = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(order):
        sums[k:] += hashes[: len(hashes) - k] * _PLACES[k]
        yield textkit.mixed(sums + np.uint64(k)) >> unused << unused, place >= k


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    new = np.flatnonzero(textkit.heads(values))
    return values[new], np.diff(np.append(new, len(values)))


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted lists with counts as one."""
    if len(keys) == 1:
        return keys[0], counts[0]
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    new = np.flatnonzero(textkit.heads(k))
    return k[new], np.add.reduceat(c, new) if len(k) else c


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys by their differences and counts, byte by byte of equal weight, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0))
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(keys), 8).T).tobytes() for x in (steps, counts.astype(np.int64))]
    return bytes(pa.Codec("zstd", compression_level=1).compress(b"".join(planes)))


def _unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.Codec("zstd").decompress(data, decompressed_size=16 * n), dtype=np.uint8)
    keys, counts = (np.ascontiguousarray(raw[at : at + 8 * n].reshape(8, n).T).reshape(-1) for at in (0, 8 * n))
    return np.cumsum(keys.view(np.uint64), dtype=np.uint64), counts.view(np.int64)


@dataclass
class Range:
    """The states of one order in a range of names: sorted names in two parts, counts up to MANY, and larger ones with their places."""

    high: np.ndarray
    low: np.ndarray
    few: np.ndarray
    at: np.ndarray
    many: np.ndarray

    @staticmethod
    def read(data: np.ndarray) -> Range:
        n, large = data[:16].view(np.int64).tolist() if len(data) else (0, 0)
        arrays, start = [], 16
        for size, kind in ((large, np.int64), (large, np.int64), (n, np.uint32), (n, np.uint16), (n, np.uint8)):
            end = start + size * np.dtype(kind).itemsize
            arrays.append(data[start:end].view(kind))
            start = end
        at, many, high, low, few = arrays
        return Range(high, low, few, at, many)

    @staticmethod
    def write(uri: str, names: np.ndarray, counts: np.ndarray, range_bits: int) -> None:
        high, low = _halves(names, range_bits)
        large = np.flatnonzero(counts >= MANY)
        with artifacts.Output(uri) as out:
            for data in (np.array([len(names), len(large)], dtype=np.int64), large.astype(np.int64), counts[large].astype(np.int64), high, low, np.minimum(counts, MANY).astype(np.uint8)):
                out.write(data)

    def counts(self, names: np.ndarray, range_bits: int) -> np.ndarray:
        """The counts of sorted names; 0 for those that aren't here."""
        out = np.zeros(len(names), dtype=np.int64)
        if not len(self.high):
            return out
        high, low = _halves(names, range_bits)
        at = np.searchsorted(self.high, high)
        open_ = np.flatnonzero(at < len(self.high))
        while len(open_):
            here = at[open_]
            alike = self.high[here] == high[open_]
            open_, here = open_[alike], here[alike]
            same = self.low[here] == low[open_]
            hit, place = open_[same], here[same]
            n = self.few[place].astype(np.int64)
            large = np.flatnonzero(n == MANY)
            n[large] = self.many[np.searchsorted(self.at, place[large])]
            out[hit] = n
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[at[open_] < len(self.high)]
        return out


def _halves(names: np.ndarray, range_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The NAME_BITS of names in 32 and 16 bits."""
    bare = names << np.uint64(range_bits) >> np.uint64(64 - NAME_BITS)
    return (bare >> np.uint64(16)).astype(np.uint32), bare.astype(np.uint16)


@dataclass(frozen=True)
class Automaton:
    """Where the automaton lies, bits of a range's number, and its totals: order, training tokens N, distinct V, those seen once."""

    folder: str
    order: int
    range_bits: int
    n: int
    distinct: int
    once: int

    def unknown(self) -> float:
        """Probability of the class of unknown words."""
        return max(self.once, 1) / (self.n + max(self.once, 1))

    def counts(self, order: int, wanted: np.ndarray) -> np.ndarray:
        """How often the n-grams of these names occurred; 0 for those that are no states."""
        out = np.zeros(len(wanted), dtype=np.int64)
        by_name = np.argsort(wanted)
        names = wanted[by_name]
        bounds = np.searchsorted(names, np.arange(1, 1 << self.range_bits, dtype=np.uint64) << np.uint64(64 - self.range_bits)) if self.range_bits else []
        cuts = [0, *np.asarray(bounds).tolist(), len(names)]
        for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                out[by_name[a:b]] = self._range(order, part).counts(names[a:b], self.range_bits)
        return out

    def _range(self, order: int, part: int) -> Range:
        """A range; its map goes with it, as a pass asks for it once."""
        return Range.read(artifacts.read(f"{self.folder}/{order}-{part}", np.uint8))


def train(docs: DataFrame, *, text: str = "text", order: int = ORDER) -> Automaton:
    """The automaton of all texts of docs; all n-grams of up to `order` words are states, however rare.

    Null and empty texts are an end alone. Repeated rows count each time. Texts of any length are counted whole. An empty
    table gives an automaton without states. Columns other than the text don't matter. See released().
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.select(F.col(f"`{text}`").alias("text"))
    size = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    bits = min(16, max(2, (size // RANGE_BYTES).bit_length()))
    folder = common.new_folder(spark, "lm")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list, list]] = [([], []) for _ in range(order)]
        for part in common.gathered(batches, 0, SHARD_BYTES):
            for k, (names, inside) in enumerate(states(*tokens(part.column(0)), order, bits)):
                keys, counts = held[k]
                for x, into in zip(counted(names[inside]), (keys, counts), strict=True):
                    into.append(x)
                if sum(map(len, keys)) > KEEP_KEYS:
                    yield from _dealt(k + 1, *added(keys, counts), bits)
                    held[k] = ([], [])
        for k, (keys, counts) in enumerate(held):
            if keys:
                yield from _dealt(k + 1, *added(keys, counts), bits)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["part", "level"]):
            level, part = group.column("level")[0].as_py(), group.column("part")[0].as_py()
            blobs = [_unpacked(x, n) for x, n in zip(group.column("blob").to_pylist(), group.column("n").to_pylist(), strict=True)]
            del group
            keys, counts = added(*(list(x) for x in zip(*blobs, strict=True)))
            del blobs
            Range.write(f"{folder}/{level}-{part}", keys, counts, bits)
            yield pa.RecordBatch.from_pydict({"level": [level], "part": [part], "states": [len(keys)], "tokens": [int(counts.sum())], "once": [int(np.count_nonzero(counts == 1))]})

    dealt = rows.mapInArrow(partial, "part bigint, level bigint, n bigint, blob binary")
    # a range's number is its partition's, so tasks have one range each
    parts = dealt.repartitionById(1 << bits, F.col("part").cast("int")).sortWithinPartitions("part", "level").mapInArrow(total, "level bigint, part bigint, states bigint, tokens bigint, once bigint")
    written = common.written(parts, "lm-parts")
    sums = written.filter("level = 1").agg(F.sum("tokens"), F.sum("states"), F.sum("once")).first()
    # ranges without n-grams have files, too
    have = written.groupBy("level").agg(F.collect_set("part").alias("parts")).collect()  # a number for each range
    common.dropped(written)
    known = {r["level"]: set(r["parts"]) for r in have}
    for level in range(1, order + 1):
        for part in set(range(1 << bits)) - known.get(level, set()):
            Range.write(f"{folder}/{level}-{part}", np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), bits)
    return Automaton(folder, order, bits, *(int(x or 0) for x in sums))


def _dealt(level: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    cuts = [0, *np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist(), len(keys)]
    for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        for at in range(a, b, BLOB_KEYS):
            end = min(b, at + BLOB_KEYS)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([level], pa.int64()), pa.array([end - at], pa.int64()), pa.array([_packed(keys[at:end], counts[at:end])], pa.binary())], names=["part", "level", "n", "blob"])


def released(spark, model: Automaton) -> None:
    """Delete the automaton; nothing that is still to be computed may need it."""
    common.delete(spark, model.folder)


@dataclass
class Local:
    """The part of the automaton that some texts can meet.

    For each order from 1 on: `at`, the number of the n-gram that ends at each token (of those of that order); `met`, whether an
    n-gram has an arc; `arc`, the arc's weight; `fail`, the weight of the failure arc of the n-gram as a state. A state is an order
    and a number; its failure link is the n-gram of the next lower order that ends at the same token. Order 0 is the state
    without words. counts: of the words.
    """

    at: list[np.ndarray]
    met: list[np.ndarray]
    arc: list[np.ndarray]
    fail: list[np.ndarray]
    counts: np.ndarray

    @classmethod
    def built(cls, model: Automaton, hashes: np.ndarray, first: np.ndarray) -> Local:
        out = cls([], [], [], [], np.zeros(0))
        p_before, counts_before = np.zeros(0), np.zeros(0)
        for k, (names, inside) in enumerate(states(hashes, first, model.order, model.range_bits)):
            distinct, place, at = np.unique(names[inside], return_index=True, return_inverse=True)
            position = np.flatnonzero(inside)[place]  # a token at which each ends
            counts = model.counts(k + 1, distinct)
            if k == 0:
                known = counts > 0
                p = np.where(known, counts / (model.n + max(model.once, 1)), model.unknown())
                out.counts, met = counts, np.ones(len(distinct), dtype=bool)  # unknown words are a class with an arc
            else:
                context, suffix = out.at[-1][position - 1], out.at[-1][position]
                before, m = counts_before[context], _smoothing(k)
                # an unknown word is no n-gram's last one
                met = (counts > 0) & (before > 0) & (out.counts[out.at[0][position]] > 0)
                p = np.where(before > 0, (np.where(met, counts, 0) + m * p_before[suffix]) / (before + m), p_before[suffix])
            number = np.full(len(hashes), -1, dtype=np.int32)
            number[inside] = at
            out.at.append(number)
            out.met.append(met)
            out.arc.append(np.log10(p))
            up = _smoothing(k + 1)
            out.fail.append(np.where(counts > 0, np.log10(up / (counts + up)), 0.0))
            p_before, counts_before = p, counts
        return out

    def walked(self, first: np.ndarray) -> np.ndarray:
        """The sum of the weights that each text passes, from its first token to its end."""
        order = len(self.at)
        lengths = np.diff(first)
        by_length = np.argsort(-lengths, kind="stable")
        begin, left = first[:-1][by_length], lengths[by_length]
        level = np.zeros(len(left), dtype=np.int64)  # of the state that each text is in
        total = np.zeros(len(left))
        active = len(left)
        for t in range(int(left[0]) if len(left) else 0):
            while active and left[active - 1] <= t:
                active -= 1
            here = begin[:active] + t
            at_level = level[:active]
            for k in range(order, 0, -1):  # the arc of order k leads from a state of order k - 1
                asking = np.flatnonzero(at_level == k - 1)
                if not len(asking):
                    continue
                token = here[asking]
                gram = self.at[k - 1][token]
                has = self.met[k - 1][gram]
                goes = asking[has]
                total[goes] += self.arc[k - 1][gram[has]]
                # where the arc leads (an unknown word to the state without words); marked, so that it isn't asked again at this token
                at_level[goes] = order + (min(k, order - 1) if k > 1 else np.where(self.counts[gram[has]] > 0, min(1, order - 1), 0))
                fails = asking[~has]
                if len(fails):
                    total[fails] += self.fail[k - 2][self.at[k - 2][here[fails] - 1]]
                    at_level[fails] = k - 2
            at_level -= order
        out = np.empty(len(total))
        out[by_length] = total
        return out


def _smoothing(k: int) -> float:
    return SMOOTHING[min(k, len(SMOOTHING) - 1)]


RESULTS = ("n_tokens", "n_known", "base_score", "score")


def scored(docs: DataFrame, model: Automaton, *, text: str = "text") -> DataFrame:
    """docs without its text and n_tokens, n_known, base_score, score (log10) of each row.

    Null texts are empty: one token, the end. Every row is scored by itself, repeated rows alike; texts of any length are
    scored whole. Columns called like the results, in whatever case, are replaced; an empty table gives an empty table.
    Without training texts each token is unknown with probability 1.
    """
    common.small_batches(docs.sparkSession)
    packed = common.Packed(docs, without=(text, *RESULTS))
    rows = packed.rows(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.log10(model.n + 0.5 * (model.distinct + 1))
        for part in common.gathered(batches, 0, PASS_BYTES):
            hashes, first = tokens(part.column(0))
            local = Local.built(model, hashes, first)
            counts = local.counts[local.at[0]]
            known, base = np.add.reduceat((counts > 0).astype(np.int64), first[:-1]), np.add.reduceat(np.log10(counts + 0.5) - rest, first[:-1])
            yield pa.RecordBatch.from_arrays([part.column(1), *map(pa.array, (np.diff(first), known, base, local.walked(first)))], names=["row", *RESULTS])

    out = rows.mapInArrow(score, packed.schema("n_tokens bigint, n_known bigint, base_score double, score double"))
    return out.select(*packed.columns(), *RESULTS)
