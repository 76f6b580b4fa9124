"""Near-duplicate documents by a chosen-path set similarity join on word shingles.

1. Each document becomes a set of 64-bit shingle hashes and, of it, K minwise tokens. Documents of equal sets fold to
   one representative (the smallest id) before anything else, so groups of copies of any size cost one row.
2. Chosen paths: in each of TREES independent trees a node passes on to its children the documents that hold a token it
   chooses; every node chooses each token with probability BRANCH / (threshold * K), by a hash of node and token, so a pair at
   the threshold is expected in BRANCH children of every node that it shares. In every first node all documents are
   compared to the node's smallest (on a byte of each of the K tokens, loosely); nodes whose documents are joined by that are done. Of the
   others, those with few pairs outside their largest component are compared exhaustively and the rest branch again.
   Nodes at the depth limit are compared in tiles.
3. The loose matches make groups. The full sets of a group come together once, and its links are confirmed on them. In a
   group of over GROUP_ROWS, all documents are first compared to PIVOTS of them on full sets; where that leaves several
   components, pairs outside the largest are compared by one task if it can hold them, and else the group goes down trees
   of its own, whose small nodes are compared on full sets.
4. Components over the confirmed links, by large and small stars.
No step makes all pairs of a node or group, and none drops or caps any. Rows of a node are counted before they are brought
together, and only nodes small enough for a task are; joins by node on the way are split by AQE where a node is large.

Recall: a pair at similarity 0.8 is in one node at every depth of a tree with a probability that falls from 71% at the first
level to no less than 37% however deep nodes have to branch (a branching process of mean BRANCH that dies out with 63%). All
TREES trees miss it with 2 * 10 ** -9 if first nodes are small and with 6 * 10 ** -4 if every node above has to branch,
twice that in a group too large for a task; its loose comparison fails with about 10 ** -6.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import common, textkit
from inkwell.llm.components import components

TOKENS = 64
TREES = 16
BRANCH = 1.25
#: A node is compared exhaustively if it has at most so many rows, and pairs of a row outside its largest component with any.
LEAF_ROWS = 1 << 14
LEAF_PAIRS = 1 << 22
LEVELS = 12
#: Rows of nodes whose leaves wait for those of later levels, to be compared with them at once.
WAITING_ROWS = 1 << 24
#: Tokens of K whose marks (a byte of each) agree at least in a loose match; at similarity 0.8, five standard deviations below the
#: mean. Equal tokens have equal marks, so a byte in place of four loses no match; other tokens' marks agree once in 256.
LOOSE = 36
SHARD_BYTES = 1 << 20
GROUP_ROWS = 1000
GROUP_BYTES = 32 << 20
GROUP_PAIRS = 1 << 25
#: Places in the lists of holders that are counted at once.
COUNTED = 1 << 18
PIVOTS = 8
BLOCK = 500
BROADCAST_IDS = 500_000

_RANDOM = np.random.Generator(np.random.PCG64(8))
_FACTORS = _RANDOM.integers(1, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROOTS = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the ends of the sets (one more entry than texts, from 0)."""
    words, first = textkit.hashed_words(texts, textkit.VISIBLE)
    n = np.diff(first)
    sums = np.zeros(len(words), dtype=np.uint64)
    for j in range(min(width, len(words))):
        sums[: len(words) - j] += words[j:] * _PLACES[j]
    short = np.flatnonzero((n > 0) & (n < width))
    for k in short:
        part = words[first[k] : first[k + 1]]
        sums[first[k] : first[k] + 1] = np.sum(part * _PLACES[: len(part)], dtype=np.uint64, keepdims=True) + _PLACES[100 + len(part)]
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    keep = np.arange(len(words)) - np.repeat(first[:-1], n) < np.repeat(count, n)
    hashes = textkit.mixed(sums[keep])
    ends = np.concatenate([[0], np.cumsum(count)])
    for k in range(len(n)):
        hashes[ends[k] : ends[k + 1]].sort()
    new = textkit.heads(hashes)
    new[ends[:-1][count > 0]] = True
    total = np.concatenate([[0], np.cumsum(new)])
    return hashes[new], total[ends]


def minwise(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """K minwise tokens of each set (uint32); all sets must have members."""
    out = np.empty((len(ends) - 1, TOKENS), dtype=np.uint32)
    if len(out):
        for k in range(TOKENS):
            out[:, k] = np.minimum.reduceat(hashes * _FACTORS[k] >> np.uint64(32), ends[:-1])
    return out


def sketches(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n (shingles), set_key (128-bit digest of the set), tokens, marks (a byte of each); null for sets without members."""
    packed = common.Packed(docs)
    rows = packed.docs.select(packed.column(text).alias("text"), packed.column(key).cast("bigint").alias("id"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.gathered(batches, 0, SHARD_BYTES):
            hashes, ends = shingle_sets(part.column(0), width)
            n = np.diff(ends)
            full = np.flatnonzero(n)
            starts = ends[:-1][full]
            digest = np.zeros((part.num_rows, 2), dtype=np.uint64)
            tokens = np.zeros((part.num_rows, TOKENS), dtype=np.uint32)
            if len(full):
                digest[full, 0] = np.add.reduceat(textkit.mixed(hashes), starts)
                digest[full, 1] = np.add.reduceat(textkit.mixed(hashes ^ _PLACES[200]), starts)
                tokens[full] = minwise(hashes, np.append(starts, len(hashes)))
            blobs = [_blobs(x, n > 0) for x in (digest, tokens, tokens.astype(np.uint8))]
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(n.astype(np.int64)), *blobs], names=["id", "n", "set_key", "tokens", "marks"])

    return rows.mapInArrow(sketch, "id bigint, n bigint, set_key binary, tokens binary, marks binary")


def _blobs(rows: np.ndarray, valid: np.ndarray) -> pa.Array:
    size = rows.shape[1] * rows.itemsize
    data = np.ascontiguousarray(rows)
    flat = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * size).astype(np.int32)), pa.py_buffer(data)])
    return flat if valid.all() else pa.array([x if v else None for x, v in zip(flat.to_pylist(), valid, strict=True)], pa.binary())


def _matrix(blobs: pa.Array, kind: type = np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), dtype=kind).reshape(-1, TOKENS)


def _chosen(tokens: np.ndarray, nodes: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and child nodes: every node takes a token of its rows with probability `rate`."""
    named = textkit.mixed(tokens.astype(np.uint64) | np.arange(TOKENS, dtype=np.uint64) << np.uint64(32))
    drawn = textkit.mixed(named ^ nodes[:, None])
    row, column = np.nonzero(drawn < np.uint64(rate * 2.0**64))
    return row, textkit.mixed(drawn[row, column] + np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)


def _roots(reps: DataFrame, rate: float) -> DataFrame:
    """(node, rid): the first level of all trees."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, ids = _matrix(batch.column(1)), np.asarray(batch.column(0))
            for root in _ROOTS[:TREES]:
                row, child = _chosen(tokens, np.full(len(ids), root), rate)
                yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(ids[row])], names=["node", "rid"])

    return reps.select("rid", "tokens").mapInArrow(grow, "node bigint, rid bigint")


def _branched(rows: DataFrame, reps: DataFrame, rate: float) -> DataFrame:
    """(node, rid, comp) one level deeper."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, child = _chosen(_matrix(batch.column(3)), np.asarray(batch.column(0)).astype(np.uint64), rate)
            yield pa.RecordBatch.from_arrays([pa.array(child), batch.column(1).take(pa.array(row)), batch.column(2).take(pa.array(row))], names=["node", "rid", "comp"])

    return rows.select("node", "rid", "comp").join(reps.select("rid", "tokens"), "rid").select("node", "rid", "comp", "tokens").mapInArrow(grow, "node bigint, rid bigint, comp bigint")


def _loose(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Of the distinct pairs (a, b) those whose marks and sizes allow a link. A b has few pairs (nodes of all trees); an a may have many."""
    left = reps.select(F.col("rid").alias("a"), F.col("n").alias("na"), F.col("marks").alias("ta"))
    right = reps.select(F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("marks").alias("tb"))
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    # dealt by b once, for the distinct pairs and for the join
    rows = pairs.repartition("b").distinct().join(right, "b").join(left, "a").filter(fits).select("a", "b", "ta", "tb")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                good = (_matrix(batch.column(2), np.uint8) == _matrix(batch.column(3), np.uint8)).sum(axis=1) >= LOOSE
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return rows.mapInArrow(agree, "a bigint, b bigint")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal (integer) keys of a sorted stream, each as one batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([np.asarray(batch.column(k)) for k in keys])
        cuts = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            key = tuple(values[:, a])
            if held and key != last:
                whole, held = common.joined(held), []  # the parts go before the run is worked on
                yield whole
                del whole
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        whole, held = common.joined(held), []
        yield whole


def _agreeing(tokens: np.ndarray, others: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of `tokens`, rows of `others` and agreeing tokens (or marks), of the loose matches; in blocks."""
    step = max(1, (1 << 22) // (max(len(others), 1) * TOKENS))
    for at in range(0, len(tokens), step):
        same = (tokens[at : at + step, None, :] == others[None, :, :]).sum(axis=2)
        fits = 100 * np.minimum(n[at : at + step, None], m[None, :]) >= percent * np.maximum(n[at : at + step, None], m[None, :])
        i, j = np.nonzero((same >= LOOSE) & fits)
        yield i + at, j, same[i, j]


def _exhausted(rows: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Loose matches (a, b) of different components in small nodes; a spanning forest of each node's is enough."""
    full = rows.select("node", "rid", "comp").join(reps.select("rid", "n", "marks"), "rid").repartition("node").sortWithinPartitions("node")  # leaves

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["node"]):
            ids, n, marks, comps = (np.asarray(group.column("rid")), np.asarray(group.column("n")), _matrix(group.column("marks"), np.uint8), np.asarray(group.column("comp")))
            labels, sizes = np.unique(comps, return_counts=True)
            asked = np.flatnonzero(comps != labels[sizes.argmax()])
            forest = Forest(comps)
            out = []
            for i, j, _ in _agreeing(marks[asked], marks, n[asked], n, percent):
                at = forest.labels()
                x, y = asked[i], j
                apart = at[x] != at[y]
                out += [(ids[p], ids[q]) for p, q in zip(x[apart].tolist(), y[apart].tolist(), strict=True) if forest.join(p, q)]
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return full.mapInArrow(compare, "a bigint, b bigint")


class Forest:
    """Disjoint sets over places 0..n-1, of which those of one label are joined already."""

    def __init__(self, labels: np.ndarray):
        first: dict = {}
        self.up = [first.setdefault(x, k) for k, x in enumerate(labels.tolist())]

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they weren't joined before."""
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y

    def labels(self) -> np.ndarray:
        return np.array([self.find(x) for x in range(len(self.up))])


def _tiles(rows: DataFrame) -> DataFrame:
    """Rows (node, rid, comp) of nodes of m rows, as nodes for each pair of blocks of BLOCK rows; for nodes at the depth limit."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("bigint")
    own = F.pmod(F.xxhash64("rid"), F.col("blocks"))
    cut = rows.select("node", "rid", "comp", blocks.alias("blocks")).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    return cut.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "rid", "comp")


def _rate(percent: int) -> float:
    return BRANCH * 100 / (percent * TOKENS)


def _descended(current: DataFrame, reps: DataFrame, percent: int, compare: Callable[[DataFrame], DataFrame], name: str, most_bytes: int | None = None, planted: Callable[[DataFrame], DataFrame] | None = None) -> list[DataFrame]:
    """Links (a, b) that compare() finds in the leaves at or below the nodes of current (node, rid, comp); written.

    Nodes of one component are done. A leaf has few enough rows and pairs of a row outside its largest component with any,
    and if most_bytes is given, sets of so many bytes in all (8 for each shingle). planted: gives the nodes of the second
    level where they aren't those of one tree. Leaves of several levels are compared at once, as long as their tables are small.
    """
    links, leaves, before, waiting = [], [], [], 0
    sized = reps.select("rid", (8 * F.col("n")).alias("bytes"))
    for level in range(1, LEVELS + 1):
        if most_bytes is not None:
            current = current.join(sized, "rid")
        else:
            current = current.withColumn("bytes", F.lit(0).cast("bigint"))
        current = common.written(current.select("node", "rid", "comp", "bytes"), f"{name}-level{level}")
        # combined before the shuffle, so a large node is no hot key
        stats = current.groupBy("node", "comp").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).groupBy("node")
        stats = stats.agg(F.sum("n").alias("m"), F.max("n").alias("top"), F.count("*").alias("comps"), F.sum("bytes").alias("bytes")).filter("comps > 1")
        leaf = (F.col("m") <= LEAF_ROWS) & ((F.col("m") - F.col("top")) * F.col("m") <= (LEAF_PAIRS if most_bytes is None else GROUP_PAIRS)) & (F.col("bytes") <= F.lit(most_bytes if most_bytes is not None else 0))
        live = common.written(current.drop("bytes").join(stats.select("node", "m", leaf.alias("leaf")), "node"), f"{name}-live{level}")
        common.dropped(current, *before)
        counts = live.agg(F.count_if("leaf").alias("small"), F.count_if(~F.col("leaf")).alias("large")).first()
        if counts["small"]:
            leaves.append(live)
            waiting += counts["small"] + counts["large"]
        last = not counts["large"] or level == LEVELS
        large = live.filter("not leaf")
        if leaves and (last or waiting > WAITING_ROWS):
            links.append(common.written(compare(_union([x.filter("leaf").select("node", "rid", "comp") for x in leaves])), f"{name}-leaves"))
            common.dropped(*[x for x in leaves if x is not live])
            leaves, waiting = [], 0
        before = [] if leaves and leaves[-1] is live else [live]
        if last:
            if counts["large"]:
                links.append(common.written(compare(_tiles(large)), f"{name}-tiles"))
            break
        current = planted(large) if planted is not None and level == 1 else _branched(large, reps, _rate(percent))
    common.dropped(*before)
    return links


def loose_groups(reps: DataFrame, percent: int) -> DataFrame:
    """(hi, lo) of the components of loose matches that the trees find; see the module's text."""
    first = common.written(_roots(reps, _rate(percent)), "path-roots")
    stats = first.groupBy("node").agg(F.count("*").alias("m"), F.min("rid").alias("pivot")).filter("m > 1")
    shared = common.written(first.join(stats.select("node", "pivot"), "node"), "path-nodes")
    stars = common.written(_loose(shared.filter("rid <> pivot").select(F.col("pivot").alias("a"), F.col("rid").alias("b")), reps, percent), "path-stars")
    comps = components(stars)
    current = shared.select("node", "rid").join(comps.select(F.col("hi").alias("rid"), F.col("lo").alias("comp")), "rid", "left").select("node", "rid", F.coalesce("comp", "rid").alias("comp"))
    links = _descended(current, reps, percent, lambda rows: _exhausted(rows, reps, percent), "path")
    groups = comps
    if links:
        groups = components(_union([comps.select(F.col("hi").alias("a"), F.col("lo").alias("b")), *links]))
        common.dropped(comps)
    common.dropped(first, shared, stars, *links)
    return groups


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    common_ = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common_ >= percent * (len(both) - common_)


def _sets(blobs: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The sets, their sizes and their tokens."""
    sets = [np.frombuffer(x, dtype=np.uint64) for x in blobs.to_pylist()]
    n = np.array([len(x) for x in sets], dtype=np.int64)
    return sets, n, minwise(np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64), np.concatenate([[0], np.cumsum(n)]))


def _views(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All members of all sets, in the array's own memory, and the sizes of the sets."""
    blobs = blobs.cast(pa.large_binary())
    ends = np.frombuffer(blobs.buffers()[1], dtype=np.int64)[blobs.offset : blobs.offset + len(blobs) + 1]
    data = blobs.buffers()[2]
    return np.frombuffer(data[ends[0] : ends[-1]] if data is not None else b"", dtype=np.uint64), np.diff(ends) // 8


def exact_links(members: np.ndarray, n: np.ndarray, comps: np.ndarray, asked: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (places of sets) of the asked ones to any that join components, by exact intersections; members: of sets of sizes n.

    The sizes of a set's intersections with all others are counted from lists of the sets that hold each of its shingles.
    Beside the members it takes some 3 times their bytes while it sorts them, and once them after that.
    """
    m, ends = len(n), np.cumsum(n)
    order = np.argsort(members, kind="stable")
    new = textkit.heads(members[order])
    number = np.empty(len(members), dtype=np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    holders = np.repeat(np.arange(m, dtype=np.int32), n)[order]
    del order
    starts = np.append(np.flatnonzero(new), len(members))
    del new
    _, label = np.unique(comps, return_inverse=True)
    left = len(np.unique(label))
    out = []
    for x in asked.tolist():
        if left == 1:
            break
        both = _shared(number[ends[x] - n[x] : ends[x]], starts, holders, m)
        near = np.flatnonzero((100 * both >= percent * (n[x] + n - both)) & (label != label[x]))
        if len(near):
            others, first = np.unique(label[near], return_index=True)
            out += [(x, y) for y in near[first].tolist()]
            label[np.isin(label, others)] = label[x]
            left -= len(others)
    return out


def _shared(own: np.ndarray, starts: np.ndarray, holders: np.ndarray, m: int) -> np.ndarray:
    """How many of the shingles `own` each of m sets holds; about COUNTED places in the lists of holders at a time."""
    both = np.zeros(m, dtype=np.int64)
    held = starts[own + 1] - starts[own]
    ends, k = np.cumsum(held), 0
    while k < len(own):
        stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + COUNTED, side="right")))
        part = held[k:stop]
        at = np.repeat(starts[own[k:stop]] - np.cumsum(part) + part, part) + np.arange(part.sum())
        both += np.bincount(holders[at], minlength=m)
        k = stop
    return both


def _pairs(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _group_links(members: DataFrame, percent: int) -> DataFrame:
    """Confirmed links of groups (grp, rid, set) that fit a task: a spanning forest of each of their components."""

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["grp"]):
            ids = np.asarray(group.column("rid"))
            if out := exact_links(*_views(group.column("set")), ids, np.arange(len(ids)), percent):
                yield _pairs([ids[x] for x, _ in out], [ids[y] for _, y in out])

    return members.select("grp", "rid", "set").repartition("grp").sortWithinPartitions("grp").mapInArrow(resolve, "a bigint, b bigint")


def _pivot_links(pivots: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """All links of pivots (grp, part, rid, set; a few for each group and part) to members (grp, part, rid, set).

    A task holds the pivots of one (grp, part) and streams that part of the members.
    """
    rows = pivots.withColumn("side", F.lit(0)).unionByName(members.withColumn("side", F.lit(1)))
    rows = rows.select(F.xxhash64("grp", "part").alias("task"), "side", "rid", "set").repartition("task").sortWithinPartitions("task", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for whole in grouped(batches, ["task", "side"]):
            if whole.column("side")[0].as_py() == 0:
                held = np.asarray(whole.column("rid")), _sets(whole.column("set"))
                continue
            ids, (sets, n, tokens) = held
            for at in range(0, whole.num_rows, 100):
                part = whole.slice(at, 100)
                own = np.asarray(part.column("rid"))
                own_sets, m, own_tokens = _sets(part.column("set"))
                out = []
                for i, j, _ in _agreeing(tokens, own_tokens, n, m, percent):
                    out += [(ids[x], own[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True) if ids[x] != own[y] and _linked(sets[x], own_sets[y], percent)]
                if out:
                    yield _pairs(*zip(*out, strict=True))

    return rows.mapInArrow(compare, "a bigint, b bigint")


def _leaf_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links confirmed on full sets that join different components of the leaves (node, rid, comp)."""
    full = rows.select("node", "rid", "comp").join(sets.select("rid", "set"), "rid").repartition("node").sortWithinPartitions("node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["node"]):
            ids, comps = np.asarray(group.column("rid")), np.asarray(group.column("comp"))
            labels, sizes = np.unique(comps, return_counts=True)
            asked = np.flatnonzero(comps != labels[sizes.argmax()])
            if out := exact_links(*_views(group.column("set")), comps, asked, percent):
                yield _pairs([ids[x] for x, _ in out], [ids[y] for _, y in out])

    return full.mapInArrow(compare, "a bigint, b bigint")


def _group_roots(members: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(node, rid, comp): the first level of all trees of each group; members (node, rid, comp), a node for each group."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _matrix(batch.column("tokens"))
            groups = textkit.mixed(np.asarray(batch.column("node")).astype(np.uint64))
            for root in _ROOTS[:TREES]:
                row, child = _chosen(tokens, textkit.mixed(groups + root), _rate(percent))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(child), batch.column("rid").take(at), batch.column("comp").take(at)], names=["node", "rid", "comp"])

    rows = members.select("node", "rid", "comp").join(reps.select("rid", "tokens"), "rid").select("node", "rid", "comp", "tokens")
    return rows.mapInArrow(grow, "node bigint, rid bigint, comp bigint")


def _large_links(sets: DataFrame, sizes: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Confirmed links of groups too large for a task; sets (grp, rid, set), written; sizes (grp, m): one row a group. Written."""
    parts = F.ceil(F.col("m") / BLOCK).cast("bigint")
    rows = sets.select("grp", "rid").join(sizes.select("grp", parts.alias("parts")), "grp")
    # the pivots: those with the smallest hashes, the smallest few of each task first
    place = F.struct(F.xxhash64("rid"), "rid")
    chosen = rows.groupBy("grp", "parts", F.pmod(F.xxhash64("rid", F.lit(3)), F.lit(PIVOTS)).alias("slot")).agg(F.min(place).alias("p")).select("grp", "parts", F.col("p.rid").alias("rid"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part")
    pivots = chosen.join(sets, ["grp", "rid"]).select("grp", every, "rid", "set")
    own = sets.join(sizes.select("grp", parts.alias("parts")), "grp").select("grp", F.pmod(F.xxhash64("rid"), F.col("parts")).alias("part"), "rid", "set")
    first = common.written(_pivot_links(pivots, own, percent), "near-pivots")
    comps = components(first)
    labelled = rows.select("grp", "rid").join(comps.select(F.col("hi").alias("rid"), F.col("lo").alias("comp")), "rid", "left").select("grp", "rid", F.coalesce("comp", "rid").alias("comp"))
    labelled = common.written(labelled, "near-labels")
    # a group is the first node; one too large for a task to compare goes on as the roots of trees
    rest = _descended(labelled.withColumnRenamed("grp", "node"), reps, percent, lambda leaves: _leaf_links(leaves, sets, percent), "near", GROUP_BYTES, lambda large: _group_roots(large, reps, percent))
    out = common.written(_union([first, *rest]), "near-large-links")
    common.dropped(first, comps, labelled, *rest)
    return out


def confirmed_links(docs: DataFrame, groups: DataFrame, reps: DataFrame, width: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Links (a, b) confirmed on full sets that join all that is linked within the groups (hi, lo); written."""
    members = groups.select(F.col("hi").alias("rid"), F.col("lo").alias("grp")).unionByName(groups.select(F.col("lo").alias("rid"), F.col("lo").alias("grp")).distinct())
    members = common.written(members.join(reps.select("rid", "n"), "rid"), "near-members")
    n = members.count()
    ids = members.select("rid", "grp")
    packed = common.Packed(docs)
    rows = packed.docs.select(packed.column(text).alias("text"), packed.column(key).cast("bigint").alias("rid")).join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "rid").select("text", "rid", "grp")

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.gathered(batches, 0, SHARD_BYTES):
            hashes, ends = shingle_sets(part.column(0), width)
            sets = pa.array([hashes[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(2), part.column(1), sets], names=["grp", "rid", "set"])

    found = rows.mapInArrow(full_sets, "grp bigint, rid bigint, set binary").filter(F.length("set") > 0)
    counts = members.groupBy("grp").agg(F.count("*").alias("m"), F.sum(8 * F.col("n")).alias("bytes"))
    large = common.written(counts.filter((F.col("m") > GROUP_ROWS) | (F.col("bytes") > GROUP_BYTES)).select("grp", "m"), "near-sizes")
    n_large = large.count()
    if not n_large:
        out = common.written(_group_links(found, percent), "near-links")
    else:
        mark = large if n_large > BROADCAST_IDS else F.broadcast(large)
        small = common.written(_group_links(found.join(mark.select("grp"), "grp", "left_anti"), percent), "near-links")
        heavy = common.written(found.join(mark.select("grp"), "grp", "left_semi"), "near-sets")
        more = _large_links(heavy, mark, reps, percent)
        out = common.written(small.unionByName(more), "near-links")
        common.dropped(small, more, heavy)
    common.dropped(members, large)
    return out


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key, n_shingles, component_id (smallest key reachable over links), kept.

    Two documents are linked if 100 * intersection >= percent * union of their sets of distinct shingles of `width` words;
    a text of fewer words is one shingle; a text without words, or null, has an empty set and no links. Texts of any length
    are read whole. Rows with one key, repeated rows too, are one document. Rows with a null key are linked to nothing and
    kept. Keys are integers. Other columns don't matter, whatever they are called. Empty tables give no rows.
    """
    common.small_batches(docs.sparkSession)
    sketched = common.written(sketches(docs, width, key, text), "sketches")
    # equal sets have equal sizes, tokens and marks: as grouping keys they need no aggregation buffer
    folded = common.written(sketched.filter("set_key is not null and id is not null").groupBy("set_key", "n", "tokens", "marks").agg(F.min("id").alias("rid")), "sets")
    reps = folded.select("rid", "n", "tokens", "marks")
    groups = loose_groups(reps, percent)
    links = confirmed_links(docs, groups, reps, width, percent, key, text)
    same = sketched.filter("set_key is not null and id is not null").select("id", "set_key").join(folded.select("set_key", "rid"), "set_key")
    # a key whose rows have several sets joins them
    several = same.filter("id <> rid").select(F.col("id").alias("a"), F.col("rid").alias("b"))
    comps = components(links.unionByName(several))
    common.dropped(links, groups, folded)
    out = sketched.select("id", "n").join(comps.select(F.col("hi").alias("id"), F.col("lo").alias("comp")), "id", "left")
    component = F.coalesce("comp", "id")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, *, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose key is the smallest of its component (and rows without key), with all their columns."""
    found = near_duplicates(docs, width=width, percent=percent, key=key, text=text)
    gone = common.written(found.filter("not kept").select(F.col(key).alias("gone_key")).distinct(), "near-gone")
    n = gone.count()
    if not n:
        return docs
    packed = common.Packed(docs)
    own = packed.docs.select(packed.column(key).cast("bigint").alias("own_key"), packed.row())
    return own.join(F.broadcast(gone) if n <= BROADCAST_IDS else gone, F.col("own_key") == F.col("gone_key"), "left_anti").select(*packed.columns())
