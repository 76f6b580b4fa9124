"""Exact dedup as a log-structured merge index, in DataFrame operations only.

Rows arrive in batches: blocks of BLOCK_ROWS rows in turn. A batch is a memtable: its digests are combined (smallest identifier,
number of rows) and flushed as a run, sorted by digest: a folder for each range of leading digest bits, the same for all
runs, and in it a sorted file. A range has a filter of FILTER_BITS bits a digest, FILTER_HASHES of them set, in blocks of 4 KB, so
that one in some 700 digests that a range doesn't hold passes it.

Before its flush a batch is looked up in the runs there are: by the filters first, which leaves candidates, and only the ranges of a run
that have candidates are read. What is found there, and what the batch itself holds twice, are the hits. FANOUT runs of a
level are merged into one of the next, range by range, keeping each digest's smallest identifier. Groups are the hits, with
what the runs say of them, and nothing else: rows that no look-up found keep themselves and are moved no more.

Hits receive byte verification: the texts of groups are compared as texts (grouped by the text, combined before the shuffle).
Whatever is counted is combined before a shuffle, so a digest with any share of the rows is no hot key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm import common

#: Rows of (digest, identifier) or (identifier) that may be broadcast: about 100 bytes each; more are joined by a shuffle.
BROADCAST_GROUPS = 200_000
#: Blocks of filters that may be broadcast: 4 KB each.
BROADCAST_FILTERS = 8_000
FILTER_BITS = 16
FILTER_HASHES = 5
#: Bits of a block of a filter; bitmap functions of Spark have blocks of this size.
BLOCK_BITS = 8 * 4096
FANOUT = 4
#: Not a multiple of FANOUT, so that runs of several levels are there at the end, and groups need their look-ups.
BATCHES = 6
BLOCK_ROWS = 128
#: Rows of a range of digests, about, and the most leading bits that tell ranges apart.
RANGE_ROWS = 1 << 16
LEAST_BITS, MOST_BITS = 3, 16


def normalised(text: Column) -> Column:
    """Each run of [\\x20\\x09-\\x0D] as one space; null as empty. Only runs other than a single space are replaced."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def digest_of(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def near(df: DataFrame, keys: int, most: int | None = None) -> DataFrame:
    """df marked for broadcast if it has few enough rows, else as it is (shuffle join; AQE splits hot keys)."""
    return F.broadcast(df) if keys <= (BROADCAST_GROUPS if most is None else most) else df


def combined(rows: DataFrame) -> DataFrame:
    """One row for each digest of (digest, id, ties, n): smallest id (null only if all are), rows that tie for it, rows."""
    counted = rows.groupBy("digest", "id").agg(F.sum("ties").alias("ties"), F.sum("n").alias("n"))
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("ties"))
    return counted.groupBy("digest").agg(F.min(order).alias("first"), F.sum("n").alias("n")).select("digest", F.col("first.id").alias("id"), F.col("first.ties").alias("ties"), "n")


@dataclass
class Run:
    """A run (range, digest, id, ties, n), sorted by digest within its ranges, and its filters: (block, bits), `blocks` for each range."""

    name: int
    table: DataFrame
    filter: DataFrame
    blocks: int


def _range(digest: Column, bits: int) -> Column:
    """The leading bits of a digest as a number."""
    return F.shiftright(F.conv(F.hex(F.substring(digest, 1, 2)), 16, 10).cast("int"), 16 - bits)


def _block(digest: Column, range_: Column, blocks: int) -> Column:
    return range_.cast("long") * blocks + F.pmod(F.xxhash64(digest), F.lit(blocks))


def _places(digest: Column) -> list[Column]:
    """The places of a digest's bits in its block, from 0."""
    return [F.pmod(F.xxhash64(F.lit(k), digest), F.lit(BLOCK_BITS)).cast("int") for k in range(1, FILTER_HASHES + 1)]


def _is_set(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(place, F.lit(8))) == 1


@dataclass
class Index:
    """The runs by level, and the hits so far.

    looked_up and skipped count (batch, run) pairs of which something, or nothing, was read; ranges_read and ranges_skipped
    count the ranges of runs.
    """

    bits: int = LEAST_BITS
    levels: list[list[Run]] = field(default_factory=list)
    hits: list[DataFrame] = field(default_factory=list)
    looked_up: int = 0
    skipped: int = 0
    ranges_read: int = 0
    ranges_skipped: int = 0
    merges: int = 0
    _names: int = 0

    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def insert(self, batch: DataFrame) -> None:
        """Add rows (digest, id): look them up, flush them as a run of the first level, and compact levels that are full."""
        ones = batch.select("digest", "id", F.lit(1).cast("long").alias("ties"), F.lit(1).cast("long").alias("n"))
        run = self._flushed(combined(ones))
        if run is None:
            return
        found, *candidates = self._look_up(run)
        self.hits.append(common.written(_union([run.table.filter("n > 1").select("digest"), *found]), "dedup-hits"))
        common.dropped(*candidates)
        self._add(run, 0)

    def _flushed(self, rows: DataFrame) -> Run | None:
        """Rows (digest, id, ties, n) as a run, each range of digests in a task and a file; None if there are none."""
        placed = rows.withColumn("range", _range(F.col("digest"), self.bits)).repartition("range").sortWithinPartitions("range", "digest")
        table = common.written(placed, "dedup-run", by="range")
        n = table.count()
        if not n:
            common.dropped(table)
            return None
        blocks = max(1, -(-n * FILTER_BITS // (BLOCK_BITS << self.bits)))
        set_ = table.select(_block(F.col("digest"), F.col("range"), blocks).alias("block"), F.explode(F.array(*_places(F.col("digest")))).alias("at"))
        filters = set_.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits"))
        self._names += 1
        return Run(self._names, table, common.written(filters, "dedup-filter"), blocks)

    def _look_up(self, batch: Run) -> tuple:
        """A list with the digests of the batch that each run holds, for the runs that may hold any; and the table it is read from."""
        candidates: DataFrame | None = None
        digest = F.col("digest")
        for run in self.runs():
            keys = batch.table.select("digest", "range", _block(digest, F.col("range"), run.blocks).alias("block"))
            keys = keys.join(near(run.filter, run.blocks << self.bits, BROADCAST_FILTERS), "block")
            for place in _places(digest):
                keys = keys.filter(_is_set(F.col("bits"), place))
            passed = keys.select("digest", "range", F.lit(run.name).alias("run"))
            candidates = passed if candidates is None else candidates.unionByName(passed)
        if candidates is None:
            return ([],)
        candidates = common.written(candidates, "dedup-candidates")
        asked: dict[int, dict[int, int]] = {}
        for r in candidates.groupBy("run", "range").agg(F.count("*").alias("n")).collect():  # a row for each range of each run
            asked.setdefault(r["run"], {})[r["range"]] = r["n"]
        found = []
        for run in self.runs():
            ranges = asked.get(run.name, {})
            self.ranges_read += len(ranges)
            self.ranges_skipped += (1 << self.bits) - len(ranges)
            self.looked_up += bool(ranges)
            self.skipped += not ranges
            if ranges:
                mine = near(candidates.filter(F.col("run") == run.name).select("digest"), sum(ranges.values()))
                found.append(run.table.filter(F.col("range").isin(sorted(ranges))).join(mine, "digest", "left_semi").select("digest"))
        return found, candidates

    def _add(self, run: Run, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) < FANOUT:
            return
        full, self.levels[level] = self.levels[level], []
        merged = self._flushed(combined(_union([r.table.drop("range") for r in full])))
        self.merges += 1
        common.dropped(*(x for r in full for x in (r.table, r.filter)))
        if merged is not None:
            self._add(merged, level + 1)

    def groups(self) -> DataFrame:
        """What the runs say of the hits: digest, id, ties, n; written. Digests that were never hit are in no group."""
        runs = self.runs()
        if not runs:
            raise ValueError("an index without rows has no groups")
        empty = runs[0].table.select("digest").limit(0)
        wanted = common.written(_union([empty, *self.hits]).distinct().withColumn("range", _range(F.col("digest"), self.bits)), "dedup-wanted")
        facts = wanted.agg(F.count("*"), F.collect_set("range")).first()  # a number for each range
        tables = [r.table.filter(F.col("range").isin(sorted(facts[1]))).join(near(wanted.select("digest"), facts[0]), "digest", "left_semi").drop("range") for r in runs]
        out = common.written(combined(_union(tables)), "dedup-groups")
        common.dropped(wanted)
        return out

    def drop(self) -> None:
        common.dropped(*(x for r in self.runs() for x in (r.table, r.filter)), *self.hits)
        self.levels, self.hits = [], []


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def flush(packed: common.Packed, key: str, text: str, batches: int) -> DataFrame:
    """(digest, id, batch) of all rows. A split's blocks of BLOCK_ROWS rows go to the batches in turn, so rows aren't moved. Written."""
    place = F.monotonically_increasing_id()
    block = F.shiftright(place, 33) + F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / BLOCK_ROWS)
    rows = packed.docs.select(digest_of(normalised(packed.column(text))).alias("digest"), packed.column(key).alias("id"), F.pmod(block, F.lit(batches)).cast("int").alias("batch"))
    return common.written(rows, "dedup-digests")


def _bodies(packed: common.Packed, key: str, text: str, *more: Column, ids: DataFrame | None = None, n: int = 0) -> DataFrame:
    """id, body, more, digest of all rows, or of those whose id is one of n ids; only these texts are normalised and hashed."""
    rows = packed.docs.select(packed.column(key).alias("id"), packed.column(text).alias("text"), *more)
    if ids is not None:
        rows = _of(rows, ids, n, "left_semi")
    return rows.withColumn("body", normalised(F.col("text"))).withColumn("digest", digest_of(F.col("body"))).drop("text")


def _of(rows: DataFrame, ids: DataFrame, n: int, kind: str) -> DataFrame:
    """Rows whose id is (left_semi) or isn't (left_anti) among ids."""
    known = near(ids.select(F.col("id").alias("known")), n)
    return rows.join(known, F.col("id").eqNullSafe(F.col("known")), kind)


def verified(packed: common.Packed, digests: DataFrame, groups: DataFrame, n: int, *, key: str, text: str) -> tuple[DataFrame, bool]:
    """The groups after their texts have been compared, and whether a digest stood for different texts.

    If one did, groups have their text (body) and are matched by it, too. Only rows whose identifier is in a group are read
    for it.
    """
    ids = common.written(digests.join(near(groups.select("digest"), n), "digest", "left_semi").select("id").distinct(), "dedup-ids")
    n_ids = ids.count()
    hits = _bodies(packed, key, text, ids=ids, n=n_ids).join(near(groups.select("digest"), n), "digest", "left_semi")
    texts = hits.groupBy("digest", "body").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("texts"))
    collided = common.written(texts.filter("texts > 1").select("digest"), "dedup-collisions")
    differ = not collided.isEmpty()
    common.dropped(collided)
    if differ:
        counted = hits.groupBy("digest", "body", "id").agg(F.count("*").alias("n"))
        order = F.struct(F.col("id").isNull(), F.col("id"), F.col("n"))
        split = counted.groupBy("digest", "body").agg(F.min(order).alias("first"), F.sum("n").alias("n"))
        groups = common.written(split.select("digest", "body", F.col("first.id").alias("id"), F.col("first.n").alias("ties"), "n"), "dedup-split")
    common.dropped(ids)
    return groups, differ


def _judged(rows: DataFrame, groups: DataFrame, n: int, by_text: bool) -> DataFrame:
    """rows (digest, id, and body if by_text) with keep_id, group_size, ties, kept; rows that tie for a group's first are all kept here."""
    on = ["digest", "body"] if by_text else ["digest"]
    known = groups.select(*on, F.col("id").alias("keep_id"), F.col("n").alias("group_size"), "ties", F.lit(True).alias("hit"))
    out = rows.join(known if by_text else near(known, n), on, "left")
    first = F.col("hit").isNull() | F.col("id").eqNullSafe(F.col("keep_id"))
    return out.withColumns({"kept": first, "keep_id": F.when(F.col("hit"), F.col("keep_id")).otherwise(F.col("id")), "group_size": F.coalesce("group_size", F.lit(1).cast("long")), "ties": F.coalesce("ties", F.lit(1).cast("long"))}).drop("hit")


def _indexed(packed: common.Packed, key: str, text: str, batches: int) -> tuple[DataFrame, DataFrame | None, int, bool]:
    """Digests of all rows; the verified groups or None; their number; whether they are matched by text, too."""
    digests = flush(packed, key, text, batches)
    rows = digests.count()
    index = Index(bits=min(MOST_BITS, max(LEAST_BITS, (rows // RANGE_ROWS).bit_length())))
    for k in range(batches):
        index.insert(digests.filter(F.col("batch") == k).select("digest", "id"))
    if not index.runs():
        return digests, None, 0, False
    groups = index.groups()
    index.drop()
    n = groups.count()
    if not n:
        return digests, None, 0, False
    groups, by_text = verified(packed, digests, groups, n, key=key, text=text)
    return digests, groups, n, by_text


def decisions(docs: DataFrame, *, key: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """One row for each row of docs: key, keep_id, group_size, kept, text_sha256 (hex, of the normalised text).

    Null texts are empty texts. Of equal texts the row with the smallest key stays; null keys come after all others;
    of rows that tie in key and text, one stays. An empty table gives an empty table. Long texts are hashed and compared
    whole. Other columns don't matter, whatever they are called. batches: memtables that the rows are inserted as.
    """
    packed = common.Packed(docs)
    digests, groups, n, by_text = _indexed(packed, key, text, batches)
    rows = _bodies(packed, key, text) if by_text else digests.drop("batch")
    if groups is None:
        out = rows.withColumns({"keep_id": F.col("id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    else:
        out = _judged(rows, groups, n, by_text)
        if not groups.filter("ties > 1").isEmpty():
            # rows that tie are alike in all that is returned: count them, and one of them stays
            columns = ["digest", "id", "keep_id", "group_size"]
            tied = out.filter("kept and ties > 1").groupBy(*columns, *(["body"] if by_text else [])).agg(F.count("*").alias("n"))
            one = F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda k: k == 1)).alias("kept")
            out = out.filter("not kept or ties = 1").select(*columns, "kept").unionByName(tied.select(*columns, one))
    return out.select(F.col("id").alias(key), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """The rows of docs that stay, all columns, whatever they are called; see decisions().

    Only rows whose key is that of a dropped row are hashed again; all others pass through.
    """
    packed = common.Packed(docs)
    digests, groups, n, by_text = _indexed(packed, key, text, batches)
    if groups is None:
        return docs
    judged = _judged(_bodies(packed, key, text) if by_text else digests, groups, n, by_text)
    gone = common.written(judged.filter("not kept or ties > 1").select("id").distinct(), "dedup-gone")
    n_gone = gone.count()
    if not n_gone:
        return docs
    own = packed.docs.select(packed.column(key).alias("id"), packed.row())
    stay = _of(own, gone, n_gone, "left_anti").select("row")
    asked = _judged(_bodies(packed, key, text, packed.row(), ids=gone, n=n_gone), groups, n, by_text).filter("kept")
    tied = asked.filter("ties > 1").dropDuplicates(["digest", "id", *(["body"] if by_text else [])])
    return stay.unionByName(asked.filter("ties = 1").select("row")).unionByName(tied.select("row")).select(*packed.columns())
