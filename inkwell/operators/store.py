"""Stored tables that are changed bucket by bucket, with versions that can be read again.

Rows lie in buckets by a hash of their key: Parquet folders data/__commit=<name>/__bucket=<number>. A version is a small table,
manifest/version=<number>: which commit holds each bucket, with the bucket's digest. A change reads and rewrites the buckets
that its keys fall into and no others; the next version points to the new folders for these and to the old ones for the rest.

Folders are never written twice. A version is there when its one file has got its name, which is the last step: readers
see the version before or the one after; what a failed or killed job wrote is named by no version and goes with prune().
One writer at a time: two that publish the same version are found out when it is read.
"""

from __future__ import annotations

import functools
import json
import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from inkwell.operators import digests

BUCKET, COMMIT = "__bucket", "__commit"
_MANIFEST = f"{BUCKET} int, {COMMIT} string, n bigint, one {digests.WIDE}, two {digests.WIDE}, version int"
#: The manifest's row for the version itself: its own commit, and rows in all.
HEAD = -1
#: So many listed keys at most are sent to all tasks, which then tell the rows that stay from those that a change is given.
LISTED = 500_000
#: Rows that stay are copied where they are read, into files of their own, if buckets have so many rows, and no more files than that.
COPIED_ROWS, COPIED_FILES = 1000, 8


@dataclass(frozen=True)
class Entry:
    """Where the rows of a bucket are, and their digest."""

    commit: str
    n: int
    one: int | None
    two: int | None

    def same_rows(self, other: Entry | None) -> bool:
        return other is not None and (self.n, self.one, self.two) == (other.n, other.one, other.two)


@dataclass(frozen=True)
class Store:
    """A stored table. It holds no rows and no state: all of that is read from the folder when asked."""

    spark: SparkSession
    path: str
    key: tuple[str, ...]
    buckets: int
    schema: StructType

    @classmethod
    def created(cls, rows: DataFrame, path: str, key: str | Sequence[str], buckets: int = 1024) -> Store:
        """A new table of these rows as version 1. Buckets: so many that one is what a small change may rewrite (say 100 MB)."""
        names = (key,) if isinstance(key, str) else tuple(key)
        if clash := {BUCKET, COMMIT} & {c.lower() for c in rows.columns}:
            raise ValueError(f"columns can't be called {sorted(clash)}")
        spark = rows.sparkSession
        about = spark.createDataFrame([(list(names), buckets, rows.schema.json())], "key array<string>, buckets int, columns string")
        about.coalesce(1).write.mode("errorifexists").parquet(f"{path}/about")
        store = cls.opened(spark, path)
        store._publish(0, store._written(rows, uuid.uuid4().hex))
        return store

    @classmethod
    def opened(cls, spark: SparkSession, path: str) -> Store:
        about = spark.read.schema("key array<string>, buckets int, columns string").parquet(f"{path}/about").first()
        return cls(spark, path.rstrip("/"), tuple(about["key"]), about["buckets"], StructType.fromJson(json.loads(about["columns"])))

    # ---- reading ----

    def versions(self) -> list[int]:
        """Versions that can be read, oldest first."""
        manifest = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        return sorted(r[0] for r in manifest.filter(F.col(BUCKET) == HEAD).select("version").distinct().collect())

    def entries(self, version: int | None = None) -> dict[int, Entry]:
        """The manifest of a version (the newest): an entry for each bucket with rows, and HEAD. As many rows as buckets."""
        version = self.versions()[-1] if version is None else version
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest").filter(F.col("version") == version).collect()
        whole = lambda x: None if x is None else int(x)
        found = {r[BUCKET]: Entry(r[COMMIT], r["n"], whole(r["one"]), whole(r["two"])) for r in rows}
        if not rows:
            raise ValueError(f"there is no version {version}")
        if len(found) < len(rows):
            raise ValueError(f"two writers published version {version}")
        return found

    def rows(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a version (the newest), of some buckets only if they are given: no other folder is listed or read."""
        return self._at(self.entries(version), buckets)

    def _at(self, entries: dict[int, Entry], buckets: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/{COMMIT}={e.commit}/{BUCKET}={b}" for b, e in sorted(entries.items()) if b != HEAD and (buckets is None or b in buckets)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        laid = StructType([*self.schema.fields, StructField(COMMIT, StringType()), StructField(BUCKET, IntegerType())])
        return self.spark.read.schema(laid).option("basePath", f"{self.path}/data").parquet(*paths).select(*self._columns())

    def looked_up(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The rows of the listed keys: only their buckets are read."""
        listed = keys.select(*self._typed()).distinct()
        return self.rows(version, self._met(listed)).join(listed, list(self.key), "left_semi")

    def digest(self, version: int | None = None) -> tuple[int, int, int]:
        """Rows and hash sums of the whole table (see digests), from the manifest alone."""
        found = [e for b, e in self.entries(version).items() if b != HEAD]
        return sum(e.n for e in found), sum(e.one or 0 for e in found), sum(e.two or 0 for e in found)

    # ---- changing ----

    def changed(self, change: Callable[[DataFrame], DataFrame], keys: DataFrame, name: str | None = None) -> int:
        """Publish what `change` makes of the rows of the buckets that the listed keys are in; the number of the version then.

        change gets present rows of these buckets, those with listed keys at least, and returns what stands in their place; the
        functions of `versions` and `changes` fit, as they act key by key. It may add, change and drop rows with listed keys; a
        row that would belong to another bucket is an error. Buckets whose rows stay the same keep their files; if all do, no
        version is published. Up to LISTED keys, rows that aren't listed go past the change, and those of large buckets are
        copied without a shuffle, until these have COPIED_FILES files each.

        name: of the commit, new each time unless given. A name that a version bears is not done again, so a batch that is
        repeated after a failure, under its own name, counts once.
        """
        versions = self.versions()
        if name is not None and self._published(_safe(name)):
            return versions[-1]
        before = self.entries(versions[-1])
        listed = {r["b"]: r["n"] for r in keys.groupBy(self._bucket().alias("b")).agg(F.count("*").alias("n")).collect()}
        met = set(listed)
        old, kept_rows, apart = self._at(before, met), None, False
        if 0 < sum(listed.values()) <= LISTED:
            named = F.broadcast(keys.select(*[c.alias(f"__key{k}") for k, c in enumerate(self._typed())]).distinct())
            same = functools.reduce(Column.__and__, [F.col(f"`{x}`").eqNullSafe(F.col(f"__key{k}")) for k, x in enumerate(self.key)])
            apart = sum(e.n for b, e in before.items() if b in met) >= COPIED_ROWS * len(met) and len(old.inputFiles()) <= COPIED_FILES * len(met)
            old, kept_rows = old.join(named, same, "left_semi"), old.join(named, same, "left_anti")
        after = self._written(change(old), name or uuid.uuid4().hex, repeated=name is not None, kept=kept_rows, apart=apart)
        if strange := set(after) - met - {HEAD}:
            raise ValueError(f"rows with keys that weren't listed, in buckets {sorted(strange)[:5]}")
        kept = {b: e for b, e in before.items() if b not in met and b != HEAD}
        fresh = {b: before[b] if e.same_rows(before.get(b)) else e for b, e in after.items() if b != HEAD}
        following = kept | fresh
        if name is None and following == {b: e for b, e in before.items() if b != HEAD}:
            return versions[-1]
        return self._publish(versions[-1], following | {HEAD: after[HEAD]})

    def becomes(self, rows: DataFrame) -> int:
        """Publish a whole table as the next version; buckets whose rows are the same by digest aren't written but shared."""
        versions = self.versions()
        before = self.entries(versions[-1])
        placed = self._placed(rows)
        found = {r[BUCKET]: Entry("", r["n"], int(r["one"]), int(r["two"])) for r in digests.digests(placed, BUCKET).collect()}
        same = {b: before[b] for b, e in found.items() if e.same_rows(before.get(b))}
        other = sorted(set(found) - set(same))
        fresh = self._written(rows, uuid.uuid4().hex, only=other)
        return self._publish(versions[-1], same | fresh)

    def prune(self, keep: int = 4) -> int:
        """Forget all but the newest `keep` versions and delete the buckets that none of these names; how many folders went.

        Not while another job writes: what it has written, but not published yet, would go too.
        """
        from pyarrow import fs

        if keep < 1:
            raise ValueError("at least the newest version must stay")
        versions = self.versions()
        needed = {(e.commit, b) for v in versions[-keep:] for b, e in self.entries(v).items() if b != HEAD}
        files, root = fs.FileSystem.from_uri(self.path if re.match(r"[a-z0-9]+:", self.path) else f"file://{self.path}")
        for v in versions[:-keep]:  # first what is named, then what it named
            files.delete_dir(f"{root}/manifest/version={v}")
        gone = 0
        for commit in files.get_file_info(fs.FileSelector(f"{root}/data")):
            if commit.type != fs.FileType.Directory:
                continue
            parts = [x for x in files.get_file_info(fs.FileSelector(commit.path)) if x.type == fs.FileType.Directory]
            name = commit.base_name.partition("=")[2]
            left = [x for x in parts if not x.base_name.startswith(f"{BUCKET}=") or (name, int(x.base_name.partition("=")[2])) not in needed]
            if len(left) == len(parts):
                files.delete_dir(commit.path)
            else:
                for x in left:
                    files.delete_dir(x.path)
            gone += len(left)
        return gone

    # ---- inside ----

    def _published(self, name: str) -> bool:
        heads = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest").filter((F.col(BUCKET) == HEAD) & (F.col(COMMIT) == name))
        return not heads.isEmpty()

    def _columns(self) -> list[Column]:
        return [F.col(f"`{f.name}`") for f in self.schema.fields]

    def _typed(self) -> list[Column]:
        return [F.col(f"`{k}`").cast(self.schema[k].dataType).alias(k) for k in self.key]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self._typed()), F.lit(self.buckets)).cast("int")

    def _met(self, keys: DataFrame) -> set[int]:
        return {r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()}

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Rows with the table's columns and types, and their bucket."""
        typed = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields])
        return typed.withColumn(BUCKET, self._bucket())

    def _written(self, rows: DataFrame, commit: str, only: list[int] | None = None, repeated: bool = False, kept: DataFrame | None = None, apart: bool = False) -> dict[int, Entry]:
        """Write rows as a commit (of some buckets, if given); its buckets' entries, and HEAD with the number of rows.

        kept: more rows, from this table's files. apart: these stay in the tasks that read them.
        """
        folder = f"{self.path}/data/{COMMIT}={commit}"
        placed = self._placed(rows)
        if only is not None:
            placed = placed.filter(F.col(BUCKET).isin(only))
        if kept is not None and not apart:
            placed = placed.unionByName(self._placed(kept))
        # dealt by bucket; AQE cuts large buckets and joins small ones
        dealt = placed.hint("rebalance", BUCKET)
        if kept is not None and apart:
            dealt = dealt.unionByName(self._placed(kept))
        dealt = dealt.sortWithinPartitions(BUCKET, *[f"`{k}`" for k in self.key])
        dealt.write.mode("overwrite" if repeated else "errorifexists").partitionBy(BUCKET).parquet(folder)
        laid = StructType([*self.schema.fields, StructField(BUCKET, IntegerType())])
        found = digests.digests(self.spark.read.schema(laid).parquet(folder), BUCKET, columns=self.schema.names).collect()
        entries = {r[BUCKET]: Entry(commit, r["n"], int(r["one"]), int(r["two"])) for r in found}
        return entries | {HEAD: Entry(commit, sum(e.n for e in entries.values()), None, None)}

    def _publish(self, before: int, entries: dict[int, Entry]) -> int:
        n = sum(e.n for b, e in entries.items() if b != HEAD)
        rows = [(b, e.commit, n if b == HEAD else e.n, e.one, e.two) for b, e in sorted(entries.items())]
        typed = self.spark.createDataFrame([(b, c, k, *(None if x is None else str(x) for x in (one, two))) for b, c, k, one, two in rows], "b int, c string, n bigint, one string, two string")
        manifest = typed.select(F.col("b").alias(BUCKET), F.col("c").alias(COMMIT), "n", *[F.col(x).cast(digests.WIDE) for x in ("one", "two")])
        manifest.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/manifest/version={before + 1}")
        return before + 1


def _safe(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9._-]+", name):
        raise ValueError("a commit's name has letters, digits, dots, dashes and underscores only")
    return name
