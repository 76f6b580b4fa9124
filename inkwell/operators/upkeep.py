"""Upkeep of a sharded corpus: routing, budgets, rebalancing, queues, quotas, integrity."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.operators import prefix

# ---- fixed values: budgets in bytes ----
HARD_LIMIT = 512 << 20
MARGIN = 50 << 20
EMBED_GUARD = 480 << 20
BYTES_PER_CHUNK = 2800
# ---- end of fixed values ----


def year_shard(year: Column) -> Column:
    """Shard by year; no year, the newest."""
    return F.when(year < 1998, "do1997").when(year < 2008, "1998_2007").when(year < 2021, "2008_2020").otherwise("2021_dosud")


def running_fill(items: DataFrame, size: Column, *order: Column | str, budget: int = HARD_LIMIT - MARGIN, group: Sequence[str] = ()) -> DataFrame:
    """shard number by cumulative size, exact up to the item that crosses a border."""
    return prefix.running(items, size, *order, group=group, name="__before").withColumn("shard", F.floor(F.col("__before") / budget).cast("bigint")).drop("__before")


class Rooms:
    """Free room of shards, and the first that has enough: a tree of largest rooms, so that both take the depth of the tree."""

    def __init__(self, budgets: Sequence[int]):
        self.width = 1 << max(0, (len(budgets) - 1).bit_length())
        self.most = [-1] * (2 * self.width)
        self.most[self.width : self.width + len(budgets)] = budgets
        for k in range(self.width - 1, 0, -1):
            self.most[k] = max(self.most[2 * k], self.most[2 * k + 1])

    def take(self, size: int | None) -> int:
        """The number of the first shard with room for it, which has less then; -1 if none has, or the size is unknown."""
        if size is None or self.most[1] < size:
            return -1
        k = 1
        while k < self.width:
            k = 2 * k if self.most[2 * k] >= size else 2 * k + 1
        found = k - self.width
        self.most[k] -= size
        while k > 1:
            k //= 2
            self.most[k] = max(self.most[2 * k], self.most[2 * k + 1])
        return found


def greedy_fill(items: DataFrame, size: str, order: str, budgets: Sequence[int], group: str = "batch") -> DataFrame:
    """First shard with room for each item, in order, within each group; -1 if none has, or its size is null.

    What an item gets depends on all before it in its group. Rows are dealt by ranges of group and order and written once; a range
    begins with the rooms that the one before left. These follow from its sum and its smallest size where one shard takes all of
    it or none; only ranges in which a shard fills up are walked for that, one after another. No task sorts more than its ranges.
    """
    spark, path = items.sparkSession, prefix.work_folder(items.sparkSession, "fill")
    schema = T.StructType([*items.schema.fields, T.StructField("shard", T.LongType())])
    dealt = items.repartitionByRange(group, order).withColumns({"__part": F.spark_partition_id(), "__id": F.monotonically_increasing_id()})
    dealt.write.partitionBy("__part").parquet(path)
    laid = T.StructType([*[f for f in dealt.schema.fields if f.name != "__part"], T.StructField("__part", T.IntegerType())])
    placed = spark.read.schema(laid).parquet(path)
    starts = _range_rooms(placed, size, order, list(budgets), group)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rooms, now, part = None, None, None
        for batch in batches:
            found = []
            for p, key, n in zip(*(batch.column(c).to_pylist() for c in ("__part", group, size)), strict=True):
                if p != part:
                    rooms, now, part = Rooms(starts.get(p, budgets)), key, p
                elif key != now:
                    rooms, now = Rooms(budgets), key
                found.append(rooms.take(n))
            kept = [batch.column(name) for name in schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, type=pa.int64())], names=schema.names)

    return placed.repartition("__part").sortWithinPartitions("__part", group, order, "__id").mapInArrow(fill, schema)


def _range_rooms(placed: DataFrame, size: str, order: str, budgets: list[int], group: str) -> dict[int, list[int]]:
    """The rooms with which each range begins that goes on with the group of the range before; a row for each range is looked at."""
    each = placed.groupBy("__part", group).agg(F.sum(size).alias("sum"), F.min(size).alias("least"))
    of = each.groupBy("__part").agg(F.min(F.struct(group)).alias("first"), F.max(F.struct(group, "sum", "least")).alias("last"))
    parts = of.orderBy("__part").collect()
    starts: dict[int, list[int]] = {}
    for before, here in zip(parts, parts[1:], strict=False):
        if before["last"][0] != here["first"][0]:
            continue
        goes_on = before["first"][0] == before["last"][0]
        rooms = list(starts.get(before["__part"], budgets)) if goes_on else list(budgets)
        total, least = before["last"][1], before["last"][2]
        for k, room in enumerate(rooms):
            if total is None or least >= 0 and room < least:
                continue
            if least >= 0 and room >= total:
                rooms[k] -= total
            else:
                rows = placed.filter((F.col("__part") == before["__part"]) & F.col(group).eqNullSafe(F.lit(before["last"][0])))
                rooms = _walked(rows.select(order, "__id", size), size, order, rooms)
            break
        starts[here["__part"]] = rooms
    return starts


def _walked(rows: DataFrame, size: str, order: str, rooms: list[int]) -> list[int]:
    """The rooms that are left after the rows of one range."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Rooms(rooms)
        for batch in batches:
            for n in batch.column(size).to_pylist():
                tree.take(n)
        left = tree.most[tree.width : tree.width + len(rooms)]
        yield pa.RecordBatch.from_arrays([pa.array([left], pa.list_(pa.int64()))], names=["left"])

    return list(rows.repartition(1).sortWithinPartitions(order, "__id").mapInArrow(walk, "left array<bigint>").first()[0])


def prioritised(rows: DataFrame, laws: DataFrame, *keys: str, current: str = "is_current") -> DataFrame:
    """rows with priority: that of a listed law, higher while it is current, else 0. laws: a short list of keys."""
    listed = laws.select(*keys).distinct().withColumn("__listed", F.lit(True))
    found = F.when(F.col("__listed") & F.coalesce(F.col(current), F.lit(False)), 5000).when(F.col("__listed"), 1000).otherwise(0)
    return rows.join(listed, list(keys), "left").withColumn("priority", found).drop("__listed")


def over_guard(sizes: DataFrame, guard: int = EMBED_GUARD) -> DataFrame:
    return sizes.filter(F.col("bytes") >= guard)


def picked(rows: DataFrame, amount: str, target: int, *order: Column | str, group: Sequence[str] = ()) -> DataFrame:
    """Rows in order until their amounts reach the target; the one that crosses it is the last."""
    return prefix.running(rows, F.col(amount), *order, group=group, name="__before").filter(F.col("__before") < target).drop("__before")


def numbered(rows: DataFrame, *order: Column | str, name: str = "n", group: Sequence[str] = ()) -> DataFrame:
    """rows with their number, from 1, in the order."""
    return prefix.running(rows, F.lit(1).cast("bigint"), *order, group=group, name="__before").withColumn(name, F.col("__before") + 1).drop("__before")


def schedule(weights: DataFrame, key: str = "key", weight: str = "weight") -> DataFrame:
    """Each key as often as its weight says: slot by slot, in the order of the keys."""
    slots = weights.filter(F.col(weight) >= 1).select(key, F.explode(F.sequence(F.lit(1), F.col(weight).cast("int"))).alias("turn"))
    return slots.withColumn("slot", F.row_number().over(Window.orderBy(key, "turn")))


def rounds(queue: DataFrame, shard: str, weight: Column, batch: int, *order: Column | str) -> DataFrame:
    """round in which each row of a shard's queue comes up, if a shard takes weight * batch rows a round."""
    ranked = numbered(queue, *order, name="__rank", group=(shard,))
    return ranked.withColumn("round", F.ceil(F.col("__rank") / (weight * batch)).cast("bigint")).drop("__rank")


def pending_main(queue: DataFrame) -> list[Column]:
    return [F.desc_nulls_last("embed_priority"), F.asc("created_at"), F.asc("id")]


def pending_shard(queue: DataFrame) -> list[Column]:
    """Current documents first, then by priority, then the most recently valid."""
    return [F.desc("is_current"), F.desc_nulls_last("embed_priority"), F.desc_nulls_last(F.coalesce("valid_until", "valid_from")), F.asc("created_at"), F.asc("id")]


def migration_order(first: Column) -> list[Column]:
    """What is first, then by the beginning or else the end of validity (unknown ones earliest), open ends last."""
    return [F.when(first, 0).otherwise(1), F.coalesce("valid_from", "valid_until", F.lit("1900-01-01").cast("date")), F.asc_nulls_last("valid_until")]


def rotated(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """key_no from 0 to n - 1 in turn."""
    return numbered(rows, *order, name="__n").withColumn("key_no", F.pmod(F.col("__n") - 1, F.lit(n)).cast("int")).drop("__n")


def within_quota(counts: DataFrame, caps: Mapping[str, float], limits: DataFrame, key: str = "key") -> DataFrame:
    """Whether each key may go on: count <= cap * limit; an unknown limit allows."""
    table = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair]) if caps else F.lit(None).cast("map<string,double>")
    cap = F.coalesce(F.try_element_at(table, F.col(key)), F.lit(1.0))
    return counts.join(limits, key, "left").withColumn("allowed", F.coalesce(F.col("count") <= cap * F.col("limit"), F.lit(True)))


def rolling_count(events: DataFrame, user: str, at: str, seconds: int = 86_400) -> DataFrame:
    """Events of the user in the window that ends with each event, itself included."""
    frame = Window.partitionBy(user).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count("*").over(frame))


def smoothed_limit(daily: Column) -> Column:
    """Estimate from a list of daily counts at the first refusal: each new one is averaged with what was estimated so far."""
    return F.aggregate(daily, F.lit(None).cast("double"), lambda known, x: F.when(known.isNull(), x.cast("double")).otherwise((known + x) / 2))


def unchecked(items: DataFrame, log: DataFrame, key: str, at: str, now: str, days: int = 30) -> DataFrame:
    """Items without a failed check in the last days."""
    recent = log.filter(F.col(at) >= F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(days))).select(key)
    return items.join(recent, key, "left_anti")


def resolved(requests: DataFrame, found: DataFrame, key: str, tried: str) -> DataFrame:
    """status of each request: fetched if found, not_found if tried in vain, else pending with a note."""
    known = found.select(key).distinct().withColumn("__hit", F.lit(True))
    status = F.when(F.col("__hit"), "fetched").when(F.col(tried), "not_found").otherwise("pending")
    return requests.join(known, key, "left").withColumns({"status": status, "note": F.when(status == "pending", "will be tried again")}).drop("__hit")


def safe_to_delete(main: DataFrame, shard: DataFrame, key: str) -> DataFrame:
    """Keys whose shard copy has as many rows as the original, and some."""
    a = main.groupBy(key).agg(F.count("*").alias("n_main"))
    b = shard.groupBy(key).agg(F.count("*").alias("n_shard"))
    return a.join(b, key).filter("n_main = n_shard and n_main > 0")


def fingerprints(rows: DataFrame, key: str, content: str, order: str, separator: str = "|") -> DataFrame:
    """md5 over a key's contents in order (ties by content), null as empty.

    A digest grows over rows that stream by in order, so a key of any number of rows is held by no task as a whole.
    """
    light = rows.select(F.col(key).alias("k"), F.col(order).alias("o"), F.coalesce(F.col(content).cast("string"), F.lit("")).alias("c"))
    kind = light.schema["k"].dataType

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest, arrow = None, None, None
        for batch in batches:
            arrow = batch.schema.field("k").type
            done: list[tuple] = []
            for k, c in zip(batch.column("k").to_pylist(), batch.column("c").to_pylist(), strict=True):
                if digest is None or k != last:
                    if digest is not None:
                        done.append((last, digest.hexdigest()))
                    last, digest = k, hashlib.md5(c.encode())
                else:
                    digest.update((separator + c).encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], arrow), pa.array([d for _, d in done])], names=["k", "fingerprint"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], arrow), pa.array([digest.hexdigest()])], names=["k", "fingerprint"])

    ordered = light.repartition("k").sortWithinPartitions("k", "o", "c").select("k", "c")
    found = ordered.mapInArrow(digested, T.StructType([T.StructField("k", kind), T.StructField("fingerprint", T.StringType())]))
    return found.withColumnRenamed("k", key)


def progress(total: Column, pending: Column) -> Column:
    """Percent done; all of nothing is 100."""
    return F.when(total == 0, F.lit(100.0)).otherwise(100.0 * (total - pending) / total)


def mostly_failing(outcomes: DataFrame) -> DataFrame:
    """One row: whether a source seems to be down (5 or more tried, more than half unavailable, none skipped)."""
    n = lambda what: F.count_if(F.col("outcome") == what)
    tried = F.count_if(F.col("outcome") != "skipped")
    return outcomes.agg(((tried >= 5) & (2 * n("unavailable") > tried) & (n("skipped") == 0)).alias("down"))


def miss_streaks(probes: DataFrame, group: str, number: str, hit: str, most: int = 12) -> DataFrame:
    """Probes up to the first run of `most` misses in a row (a hit begins anew); what comes after was never asked for."""
    by = Window.partitionBy(group).orderBy(number)
    island = F.sum(F.col(hit).cast("int")).over(by)
    rows = probes.withColumn("__island", island)
    run = F.sum((~F.col(hit)).cast("int")).over(Window.partitionBy(group, "__island").orderBy(number))
    rows = rows.withColumn("misses", F.when(F.col(hit), 0).otherwise(run))
    stop = F.min(F.when(F.col("misses") >= most, F.col(number))).over(Window.partitionBy(group))
    return rows.withColumn("__stop", stop).filter(F.col("__stop").isNull() | (F.col(number) <= F.col("__stop"))).drop("__island", "__stop")


def first_known(rows: DataFrame, key: str, at: str, values: Sequence[str]) -> DataFrame:
    """For each key the first non-null of each value in order of sight, and where it was seen first."""
    firsts = [F.min_by(F.col(v), F.when(F.col(v).isNotNull(), F.col(at))).alias(v) for v in values]
    return rows.groupBy(key).agg(F.min(at).alias("first_seen"), *firsts)


def outdated(runs: DataFrame, by: str, *order: Column | str, keep: int = 4) -> DataFrame:
    """Backups that go: all but the newest `keep` of each, in the order given."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return runs.withColumn("__rank", rank).filter(F.col("__rank") > keep).drop("__rank")


def used_up(daily: DataFrame, user: str, day: str, n: str, most: int) -> DataFrame:
    """daily counts with the user's total up to each day and whether it is over the quota."""
    total = F.sum(n).over(Window.partitionBy(user).orderBy(day))
    return daily.withColumns({"total": total, "over_trial": total > most})


def guarded(old: DataFrame, new: DataFrame, key: str, protected: Sequence[str], is_admin: Column) -> DataFrame:
    """New rows, with the old values of protected columns where the writer is no administrator."""
    before = old.select(key, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in protected])
    keep = F.col("__hit") & ~F.coalesce(is_admin, F.lit(False))
    return new.join(before, key, "left").select(*[F.when(keep, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in protected else F.col(c) for c in new.columns])


def visible_to(rows: DataFrame, profiles: DataFrame, user: str, statuses: Sequence[str] = ("approved",)) -> DataFrame:
    """All rows if the user's profile has one of the statuses, else none: a secured view."""
    may = profiles.filter((F.col("id") == user) & F.col("status").isin(*statuses)).select(F.lit(True).alias("__may")).limit(1)
    return rows.crossJoin(F.broadcast(may)).drop("__may")  # one row at most


def page_of_shards(counts: Sequence[tuple[str, int]], offset: int, limit: int) -> Iterator[tuple[str, int, int]]:
    """(shard, offset, limit) of each shard that a global page touches; others need not be read."""
    for shard, n in counts:
        take = max(0, min(n - offset, limit)) if offset < n else 0
        if take:
            yield shard, offset, take
            limit -= take
        offset = max(0, offset - n)


def clamped(limit: int | None, offset: int | None) -> tuple[int, int]:
    return min(100, max(1, 20 if limit is None else limit)), max(0, offset or 0)
