"""Versions of documents: change detection, slowly changing rows, reuse of embeddings, as-of predecessors.

Only immutable tables are at hand, so each operator is a pure function from old and new rows to the next snapshot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import mappings
from inkwell.operators import prefix


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of their key."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def first_write_wins(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def merged(old: DataFrame, new: DataFrame, key: str, updated: list[str]) -> DataFrame:
    """Of matched rows only the `updated` columns change; unmatched new rows are added as they are."""
    renamed = new.select(F.col(key), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in updated])
    kept = old.join(renamed, key, "left").select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in updated else F.col(c) for c in old.columns])
    return kept.unionByName(new.join(old.select(key), key, "left_anti").select(*[F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns]))


def classified(old: DataFrame, new: DataFrame, key: str, mark: str) -> DataFrame:
    """key and outcome of each new row: inserted, unchanged (marks equal, null-safe) or changed."""
    known = old.select(F.col(key), F.col(mark).alias("__old"), F.lit(True).alias("__hit"))
    outcome = F.when(F.col("__hit").isNull(), "inserted").when(F.col("__old").eqNullSafe(F.col(mark)), "unchanged").otherwise("changed")
    return new.join(known, key, "left").select(key, outcome.alias("outcome"))


def rolled(live: DataFrame, new: DataFrame, key: str, version: str, today: str, *, content_counts: DataFrame | None = None, known_only: bool = False, told_apart: bool = True) -> DataFrame:
    """Next snapshot of live rows (key, version, valid_from, valid_until, is_current, status, superseded_by).

    A row whose version changes is archived as it was (its key gets the version's last 40 characters) and a live row with
    the new version begins; equal versions stay; unknown keys are added. new: (key, version, valid_from). content_counts
    (key, n): new versions without content don't replace anything. known_only: a row without a version isn't archived, its
    new version just takes its place. Keys of archived rows are those of mappings.archive_key(); rows without a version
    get a digest of their values in it, so that two of one key don't clash (told_apart=False: nothing, and they do).
    """
    usable = new if content_counts is None else new.join(content_counts.filter("n > 0").select(key), key, "left_semi")
    day = F.to_date(F.lit(today))
    current = live.filter("is_current")
    past = live.filter("not coalesce(is_current, false)")
    both = current.join(usable.select(F.col(key), F.col(version).alias("__new"), F.col("valid_from").alias("__from"), F.lit(True).alias("__hit")), key, "left")
    changed = F.coalesce(F.col("__hit"), F.lit(False)) & ~F.col(version).eqNullSafe(F.col("__new"))
    columns = live.columns

    def row(df: DataFrame, **values: Column) -> DataFrame:
        return df.select(*[values[c].alias(c) if c in values else F.col(c) for c in columns])

    stay = row(both.filter(~changed))
    kept = both.filter(changed & F.col(version).isNotNull()) if known_only else both.filter(changed)
    archive = row(kept, **{key: mappings.archive_key(F.col(key), F.col(version), *([F.col(c) for c in columns] if told_apart else [])), "valid_until": day, "is_current": F.lit(False), "status": F.lit("historicky"), "superseded_by": F.col(key)})
    begin = row(both.filter(changed), **{version: F.col("__new"), "valid_from": F.coalesce(F.col("__from"), day), "valid_until": F.lit(None).cast("date")})
    added = usable.join(current.select(key), key, "left_anti")
    added = row(added.withColumns({c: F.lit(None).cast(live.schema[c].dataType) for c in columns if c not in added.columns}), is_current=F.lit(True), status=F.lit("platny"))
    return past.unionByName(stay).unionByName(archive).unionByName(begin).unionByName(added)


def intervals(rows: DataFrame, key: str, start: str, *ties: str) -> DataFrame:
    """valid_from, valid_until (the day before the next version's start) and is_current by key and start; `ties` order one start's."""
    following = F.lead(F.to_date(start)).over(Window.partitionBy(key).orderBy(start, *ties))
    return rows.withColumns({"valid_from": F.to_date(start), "valid_until": F.date_sub(following, 1), "is_current": following.isNull()})


def reused_embeddings(old: DataFrame, new: DataFrame) -> DataFrame:
    """New chunks with the embedding of an old one of equal heading (null equals null) and content; the last of several."""
    donors = old.filter("embedding is not null").groupBy("document_id", "heading", "content").agg(F.max(F.struct("chunk_index", "embedding")).alias("last"))
    o, n = donors.alias("o"), new.alias("n")
    same = (F.col("o.document_id") == F.col("n.document_id")) & F.col("o.heading").eqNullSafe(F.col("n.heading")) & (F.col("o.content") == F.col("n.content"))
    return n.join(o, same, "left").select(*[F.col(f"n.{c}") for c in new.columns if c != "embedding"], F.col("o.last.embedding").alias("embedding"))


def shrunk(old_counts: DataFrame, new_counts: DataFrame, key: str, least: int = 5, share: float = 0.3) -> DataFrame:
    """key, n_old, n_new and whether a version lost so much that someone should look."""
    both = old_counts.select(key, F.col("n").alias("n_old")).join(new_counts.select(key, F.col("n").alias("n_new")), key)
    return both.withColumn("warn", (F.col("n_old") >= least) & (F.col("n_new") < F.col("n_old") * share))


def predecessors(rows: DataFrame, versions: DataFrame, path: str = "path", version: str = "version") -> DataFrame:
    """rows and the longest version whose path is theirs or a prefix of it up to a slash; null without one.

    Each row's ancestor paths are exploded (as many as it has segments) and joined on equality: no range join.
    """
    spread = ancestors(rows.withColumn("__id", F.monotonically_increasing_id()), path)
    hits = spread.join(versions.select(F.col(version).alias("ancestor")), "ancestor").groupBy("__path").agg(F.max_by("ancestor", F.length("ancestor")).alias("of"))
    return rows.join(hits, F.col(path) == F.col("__path"), "left").drop("__path")


def first_prefixes(rows: DataFrame, versions: DataFrame, path: str, version: str, order: str) -> DataFrame:
    """rows and the first version, in the order of the versions, of which their path is a continuation after a slash; null without one."""
    known = versions.groupBy(F.col(version).alias("ancestor")).agg(F.min(order).alias("__order"))
    hits = ancestors(rows, path).filter(F.col("ancestor") != F.col("__path")).join(known, "ancestor").groupBy("__path").agg(F.min_by("ancestor", "__order").alias(version))
    return rows.join(hits, F.col(path) == F.col("__path"), "left").drop("__path")


def ancestors(rows: DataFrame, path: str) -> DataFrame:
    """(path, ancestor) for each different path and each of its prefixes that end at a slash or its end."""
    different = rows.select(F.col(path).alias("__path")).filter("__path is not null").distinct()
    return different.select("__path", F.explode(_ancestor_list("__path")).alias("ancestor"))


def _ancestor_list(path: str, levels: Sequence[int] | None = None) -> Column:
    """The prefixes of a path that end at a slash or its end; those of some numbers of segments only, if they are given."""
    segments = F.split(F.col(path), "/")
    upto = lambda k: F.array_join(F.slice(segments, 1, k), "/")
    if levels is None:
        return F.transform(F.sequence(F.lit(1), F.size(segments)), upto)
    return F.transform(F.filter(F.array(*[F.lit(k) for k in levels]).cast("array<int>"), lambda k: k <= F.size(segments)), upto)


def section_parts(nodes: DataFrame, fragments: DataFrame, most: int | None = 3000, part_chars: int = 1 << 20, span: int = 1024) -> DataFrame:
    """For each section node the texts at or below it, in order, joined by spaces, in parts of about part_chars characters: no
    row holds more than that and one fragment. Empty sections leave gaps in chunk_index.

    nodes: document_id, path, heading, ord; fragments: path, ord, text. Of a document's sections the first `most` are taken, the
    others are left out (None: all). Parts in the order of `part`, joined by spaces, are the content; numbers may be missing where a fragment is longer than
    a part. ord of fragments is a whole number: a fragment's place is a sum over ranges of `span` numbers and one within
    its range, so that one large section is not one task.

    Fragments move once to find their sections, only at the levels at which sections are; what lies in none goes no further.
    """
    spark, folder = nodes.sparkSession, prefix.work_folder(nodes.sparkSession, "sections")
    order = Window.partitionBy("document_id").orderBy("ord", "path")
    numbered = nodes.withColumn("chunk_index", F.row_number().over(order) - 1).filter(F.lit(True) if most is None else F.col("chunk_index") < most).select("document_id", "path", "chunk_index", "heading")
    numbered.write.parquet(f"{folder}/nodes")
    numbered = spark.read.schema(numbered.schema).parquet(f"{folder}/nodes").filter("path is not null")
    levels = sorted(r[0] for r in numbered.select(F.size(F.split("path", "/"))).distinct().collect())  # as many as a path has segments
    said = fragments.select(F.col("path").alias("fragment_path"), F.col("ord").alias("fragment_ord"), F.trim("text").alias("text")).filter("text <> '' and fragment_path is not null")
    above = _ancestor_list("fragment_path", levels)
    rows = said.withColumn("ancestor", F.explode(above)).join(numbered, F.col("ancestor") == F.col("path")).drop("ancestor", "path").withColumn("range", F.floor(F.col("fragment_ord") / span))
    if levels:
        rows.write.parquet(f"{folder}/fragments")
        rows = spark.read.schema(rows.schema).parquet(f"{folder}/fragments")
    else:
        rows = spark.createDataFrame([], rows.schema)
    by, sized = ["document_id", "chunk_index", "range"], F.length("text").cast("bigint") + 1
    upto = Window.partitionBy("document_id", "chunk_index").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*by).agg(F.sum(sized).alias("size")).select(*by, F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*by).orderBy("fragment_ord", "fragment_path", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum(sized).over(inside), F.lit(0))).join(starts, by)
    placed = placed.withColumn("part", F.floor((F.col("start") + F.col("inner")) / part_chars))
    texts = F.array_sort(F.collect_list(F.struct("fragment_ord", "fragment_path", "text")))
    return placed.groupBy("document_id", "chunk_index", "heading", "part").agg(F.array_join(F.transform(texts, lambda x: x["text"]), " ").alias("content"))
