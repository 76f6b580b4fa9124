"""Changes to stored rows: refreshes, gated updates, deletions, moves and archive repairs.

Tables are immutable, so each operator is a pure function from snapshots to the next snapshots; what a store would do in
one transaction comes back as several DataFrames that are to be written together. Lists of keys are tables, joined and never
collected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import mappings
from inkwell.operators import versions

#: Pages of a file of append_pages().
PAGES = 2000


def _hit(rows: DataFrame, ids: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """rows with __hit: whether their key is among the ids."""
    known = ids.select(F.col(other or key).alias("__id")).distinct().withColumn("__hit", F.lit(True))
    return rows.join(known, F.col(key) == F.col("__id"), "left").withColumn("__hit", F.coalesce("__hit", F.lit(False))).drop("__id")


def _like(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """rows with the columns of a table, null where they have none."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(columns.schema[c].dataType).alias(c) for c in columns.columns])


def append_pages(rows: DataFrame, path: str, per_page: int = 500) -> None:
    """Append rows to a Parquet table in pages of at most per_page rows; a task's pages count only if all of it is done.

    A page is a row group: held, written and found by itself, but not a file of its own, as files are listed and committed one
    by one. A file has at most PAGES of them, which keeps its footer small.
    """
    rows.write.mode("append").option("parquet.block.row.count.limit", per_page).option("maxRecordsPerFile", per_page * PAGES).parquet(path)


def append_log(entries: DataFrame, path: str, asked: str = "query", preview: int = 200) -> None:
    """Append entries to a log, a Parquet table: of what was asked the first `preview` characters only, as query_preview."""
    entries.withColumn("query_preview", F.substring(asked, 1, preview)).drop(*({asked} - {"query_preview"})).write.mode("append").parquet(path)


def refreshed(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str], now: str) -> DataFrame:
    """Rows seen again get the new `columns`, are current again and bear the time; unknown ones are added; all others stay."""
    at = F.to_timestamp(F.lit(now))
    seen = new.select(F.col(key).alias("__key"), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in columns])
    both = old.join(seen, F.col(key) == F.col("__key"), "left")
    given = {c: F.col(f"__{c}") for c in columns} | {"is_current": F.lit(True), "fetched_at": at}
    kept = both.select(*[F.when(F.col("__hit"), given[c]).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in old.columns])
    added = new.join(old.select(key), key, "left_anti").withColumns({"is_current": F.lit(True), "fetched_at": at})
    return kept.unionByName(_like(added, old))


def hash_gated(old: DataFrame, chunks: DataFrame, new: DataFrame, key: str, now: str, *, content: str = "content", parent: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """Next documents and chunks: equal hashes change nothing; a changed document is updated, un-embedded and loses its chunks.

    old has content_hash, is_embedded, updated_at; new has the key and the content.
    """
    digest = F.sha2(F.encode(F.col(content), "UTF-8"), 256)
    fresh = new.select(key, content, digest.alias("content_hash"))
    before = old.select(F.col(key).alias("__key"), F.col("content_hash").alias("__hash"))
    changed = fresh.join(before, F.col(key) == F.col("__key"), "left").filter(F.col("__key").isNull() | ~F.col("__hash").eqNullSafe(F.col("content_hash"))).drop("__key", "__hash")
    next_rows = _like(changed.withColumns({"is_embedded": F.lit(False), "updated_at": F.to_timestamp(F.lit(now))}), old)
    docs = old.join(changed.select(key), key, "left_anti").unionByName(next_rows)
    left = chunks.join(changed.select(F.col(key).alias(parent)), parent, "left_anti")
    return docs, left


def deleted(parents: DataFrame, children: DataFrame, ids: DataFrame, key: str, parent: str, *, dry_run: bool = True, confirmed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Next parents, next children and one row (n_parents, n_children, done) of what goes.

    Children go first, then their parents. Nothing goes unless it is no dry run and is confirmed: two keys.
    """
    really = not dry_run and confirmed
    marked_parents, marked_children = _hit(parents, ids, key), _hit(children, ids, parent, key)
    counts = marked_parents.agg(F.count_if("__hit").alias("n_parents")).crossJoin(F.broadcast(marked_children.agg(F.count_if("__hit").alias("n_children"))))  # one row each
    counts = counts.withColumn("done", F.lit(really))
    if not really:
        return parents, children, counts
    return marked_parents.filter("not __hit").drop("__hit"), marked_children.filter("not __hit").drop("__hit"), counts


def without_unembedded(chunks: DataFrame, ids: DataFrame, key: str, parent: str = "document_id", embedding: str = "embedding") -> DataFrame:
    """Chunks but for those of the given documents that have no embedding."""
    return _hit(chunks, ids, parent, key).filter(~(F.col("__hit") & F.col(embedding).isNull())).drop("__hit")


def flagged(rows: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    """rows with the flag set where the key is listed; others keep theirs."""
    return _hit(rows, ids, key).withColumn(flag, F.when(F.col("__hit"), True).otherwise(F.col(flag))).drop("__hit")


def offloaded(chunks: DataFrame, uploaded: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Next chunks, the contents that moved, and one row (n) with their number.

    A chunk gives its content up only if it is uploaded and wasn't migrated before; a second call moves nothing.
    """
    marked = _hit(chunks, uploaded, key)
    moves = F.col("__hit") & ~F.coalesce(F.col("content_migrated"), F.lit(False))
    after = marked.withColumns({"content": F.when(moves, None).otherwise(F.col("content")), "content_migrated": F.when(moves, True).otherwise(F.col("content_migrated"))}).drop("__hit")
    moved = marked.filter(moves).select(key, "content")
    return after, moved, marked.agg(F.count_if(moves).alias("n"))


def archived(docs: DataFrame, chunks: DataFrame, archive: DataFrame, key: str, ident: str, parent: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """Next documents and chunks after archive rows have come in, and their ids by key in `ident`.

    An archive row whose key is there already isn't added: the existing row is used, and its old chunks go, so that chunks
    written for it next aren't doubled.
    """
    existing = docs.join(archive.select(key).distinct(), key, "left_semi")
    added = archive.join(docs.select(key), key, "left_anti")
    left = chunks.join(existing.select(F.col(ident).alias(parent)), parent, "left_anti")
    return docs.unionByName(_like(added, docs)), left


def superseded_by_title(docs: DataFrame, key: str = "id", title: str = "title", day: str = "published") -> DataFrame:
    """docs with is_current: a title that says what number it was before makes other documents of that number historical,
    whichever came first; of two that replace the same number the later one stays.

    Numbers are extracted once from each title and joined by equality.
    """
    replaced = mappings.replaced_number(F.col(title))
    by = docs.select(F.struct(F.col(day), F.col(key)).alias("__by"), replaced.alias("__number")).filter("__number is not null")
    of = docs.select(F.struct(F.col(day), F.col(key)).alias("__of"), replaced.alias("__replaced"), F.explode(mappings.numbers(F.col(title))).alias("__number"))
    older = F.col("__replaced").isNull() | (F.col("__replaced") != F.col("__number")) | (F.col("__by") > F.col("__of"))
    gone = of.join(by, "__number").filter((F.col(f"__by.{key}") != F.col(f"__of.{key}")) & older).select(F.col(f"__of.{key}").alias("__gone")).distinct()
    marked = docs.join(gone.withColumn("__hit", F.lit(True)), F.col(key) == F.col("__gone"), "left")
    return marked.withColumn("is_current", F.when(F.col("__hit"), False).otherwise(F.col("is_current"))).drop("__gone", "__hit")


def valid_acts(records: DataFrame, today: str) -> DataFrame:
    """citation, subtype, title of each act in force: of its kind, not repealed, not ended by today; a citation's last record wins.

    records: seq (their order), kind, citation, other_citation, repealed, ends, subtype, title, declared.
    """
    citation = F.coalesce(F.nullif("citation", F.lit("")), F.nullif("other_citation", F.lit("")))
    in_force = (F.col("kind") == "PRAVPRED") & F.col("repealed").isNull() & (F.col("ends").isNull() | (F.col("ends") > F.to_date(F.lit(today))))
    rows = records.filter(in_force).select("seq", citation.alias("citation"), "subtype", F.coalesce("title", "declared", citation).alias("title")).filter("citation is not null")
    last = rows.groupBy("citation").agg(F.max_by(F.struct("subtype", "title"), "seq").alias("r"))
    return last.select("citation", mappings.doc_type(F.col("r.subtype")).alias("doc_type"), "r.title")


def historical_versions(versions: DataFrame, subtypes: DataFrame, cutoff: str) -> DataFrame:
    """Versions that have ended, not before the cutoff, of acts whose subtype is a known one; with doc_type."""
    ended = versions.filter(F.col("ends").isNotNull() & (F.col("ends") >= F.to_date(F.lit(cutoff)))).filter("citation is not null and version is not null")
    known = subtypes.select("citation", mappings.doc_type(F.col("subtype"), None).alias("doc_type")).filter("doc_type is not null")
    return ended.join(known, "citation")


def history_import(found: DataFrame, imported: DataFrame, *order: Column | str, version: str = "version", most: int | None = 500) -> DataFrame:
    """Versions not imported yet, the first `most` in order (None: all), as rows that are not current and not to be embedded."""
    todo = found.join(imported.select(version), version, "left_anti").orderBy(*order)
    return (todo if most is None else todo.limit(most)).withColumns({"is_current": F.lit(False), "skip_embedding": F.lit(True)})


def chunkless_history(docs: DataFrame, chunks: DataFrame, key: str = "id", parent: str = "document_id") -> DataFrame:
    """Historical documents without any chunk: those to backfill."""
    return docs.filter("not is_current").join(chunks.select(F.col(parent).alias("__parent")), F.col(key) == F.col("__parent"), "left_anti")


def backfilled(docs: DataFrame, chunks: DataFrame, nodes: DataFrame, fragments: DataFrame, key: str = "id", most: int | None = 3000, part_chars: int = 1 << 20) -> DataFrame:
    """The chunks that historical documents without any should have: document_id, chunk_index, heading, part, content.

    Made from the section nodes (document_id, path, heading, ord) and text fragments (path, ord, text) of these documents alone;
    see versions.section_parts(). A second run, with the chunks added, finds none to make.
    """
    lacking = chunkless_history(docs, chunks, key).select(F.col(key).alias("document_id")).distinct()
    return versions.section_parts(nodes.join(lacking, "document_id", "left_semi"), fragments, most, part_chars)


def outside_era(is_new: Column, year: Column, first: int = 1945, last: int = 1950) -> Column:
    """New acts of an era are left out; known ones and those without a year stay."""
    return ~(is_new & F.coalesce(year.between(first, last), F.lit(False)))


def copied_version(new: DataFrame, old: DataFrame, key: str, version: str, at: str) -> DataFrame:
    """key, status and version: set from the old row if that isn't newer, else stale; missing without one."""
    before = old.select(F.col(key).alias("__key"), F.col(version).alias("__version"), F.col(at).alias("__at"))
    status = F.when(F.col("__key").isNull(), "missing").when(F.col("__at") <= F.col(at), "set").otherwise("stale")
    both = new.join(before, F.col(key) == F.col("__key"), "left").withColumn("status", status)
    return both.select(key, "status", F.when(F.col("status") == "set", F.col("__version")).otherwise(F.col(version)).alias(version))


def colocated(reports: DataFrame, laws: DataFrame, explains: str, key: str, shard: str = "shard") -> DataFrame:
    """reports with the shard of the law they explain; `skipped` where the law isn't there yet."""
    homes = laws.select(F.col(key).alias("__law"), F.col(shard).alias("__shard"))
    return reports.join(homes, F.col(explains) == F.col("__law"), "left").withColumns({shard: F.col("__shard"), "skipped": F.col("__law").isNull()}).drop("__law", "__shard")


def wanted_texts(needed: DataFrame, texts: DataFrame, key: str, at: str, text: str = "text") -> DataFrame:
    """The first text of each needed key, in the order of `at`; a blank first text uses its key up and gives nothing."""
    first = texts.join(needed.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.min_by(F.struct(F.col(text)), at).alias("f"))
    return first.select(key, F.col(f"f.{text}").alias(text)).filter(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0)


def first_versions(rows: DataFrame, key: str, order: str, values: Sequence[str], *, last: bool = False) -> DataFrame:
    """For each key the values of its first (or last) row."""
    pick = F.max_by if last else F.min_by
    return rows.groupBy(key).agg(pick(F.struct(*values), F.col(order)).alias("v")).select(key, *[F.col(f"v.{c}").alias(c) for c in values])


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns that both have, in the order of the left."""
    return [c for c in left.columns if c in set(right.columns)]


def moved(source: DataFrame, target: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Next source, next target and (key, n_source, n_target, verified): rows are copied, counted on both sides, then deleted.

    A key whose copy doesn't count as many rows as its original (the target had some before) keeps its original. Only columns
    of both are copied.
    """
    columns = shared_columns(source, target)
    copies = source.join(ids.select(key).distinct(), key, "left_semi").select(*columns)
    after = target.unionByName(_like(copies, target))
    # one pass over keys: what is there afterwards is what was there and the copies
    sides = [rows.select(key, F.lit(side).alias("__side")) for side, rows in enumerate((source, target, ids))]
    n = lambda side: F.count_if(F.col("__side") == side)
    counts = sides[0].unionByName(sides[1]).unionByName(sides[2]).filter(F.col(key).isNotNull()).groupBy(key).agg(n(0).alias("n_source"), (n(0) + n(1)).alias("n_target"), n(2).alias("__listed"))
    report = counts.filter("__listed > 0 and n_source > 0").drop("__listed").withColumn("verified", F.col("n_source") == F.col("n_target"))
    left = source.join(report.filter("verified").select(key), key, "left_anti")
    return left, after, report


def shard_report(docs: DataFrame, chunks: DataFrame, key: str = "id", parent: str = "document_id", shard: str = "shard", pending: str = "pending") -> DataFrame:
    """shard, documents, complete (all chunks embedded, and some), chunks, pending, percent; and a row `all` for a document in any shard.

    A document that is in several shards counts once in `all`, with the chunks of all of them.
    """
    counts = chunks.groupBy(shard, F.col(parent).alias(key)).agg(F.count("*").alias("n"), F.count_if(pending).alias("open"))
    rows = docs.select(shard, key).distinct().join(counts, [shard, key], "left").select(shard, key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("open", F.lit(0)).alias("open"))
    whole = rows.groupBy(key).agg(F.sum("n").alias("n"), F.sum("open").alias("open")).withColumn(shard, F.lit("all"))
    both = rows.unionByName(whole.select(shard, key, "n", "open"))
    done = F.count_if((F.col("n") > 0) & (F.col("open") == 0))
    out = both.groupBy(shard).agg(F.count("*").alias("documents"), done.alias("complete"), F.sum("n").alias("chunks"), F.sum("open").alias("pending"))
    return out.withColumn("percent", F.when(F.col("chunks") == 0, 100.0).otherwise(100.0 * (F.col("chunks") - F.col("pending")) / F.col("chunks")))


def first_phase(rows: DataFrame, priority: Column, current: Column) -> Column:
    """0 for current documents of highest priority, which are drained first in all shards; 1 for the rest."""
    return F.when(priority & F.coalesce(current, F.lit(False)), 0).otherwise(1)


def batched(rows: DataFrame, size: int, group: str, *order: Column | str) -> DataFrame:
    """rows with `batch`: their number, from 0, among batches of `size` rows of a group."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1) / size).cast("bigint"))


def served_rounds(batches: DataFrame, shard: str, number: str, size: str, empty: int = 3) -> DataFrame:
    """Batches a shard is asked for until `empty` in a row were empty: later ones are never asked for."""
    by = Window.partitionBy(shard).orderBy(number)
    rows = batches.withColumn("__island", F.sum((F.col(size) > 0).cast("int")).over(by))
    rows = rows.withColumn("__run", F.sum((F.col(size) == 0).cast("int")).over(Window.partitionBy(shard, "__island").orderBy(number)))
    stop = F.min(F.when((F.col(size) == 0) & (F.col("__run") >= empty), F.col(number))).over(Window.partitionBy(shard))
    return rows.withColumn("__stop", stop).filter(F.col("__stop").isNull() | (F.col(number) <= F.col("__stop"))).drop("__island", "__run", "__stop")


def embed_today(queue: DataFrame, log: DataFrame, day: str, budget: int, page: int, *order: Column | str, most_failures: int = 3, key: str = "id") -> DataFrame:
    """The rows to embed now: a page at most, no more than what the day's budget leaves, none that failed too often.

    log: id, at, ok. The budget counts the day's attempts.
    """
    spent = log.filter(F.to_date("at") == F.to_date(F.lit(day))).agg(F.count("*").alias("spent"))
    failed = log.filter("not ok").groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= most_failures)
    first = queue.join(failed.select(key), key, "left_anti").orderBy(*order).limit(page)
    numbered = first.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # a page of rows
    return numbered.crossJoin(F.broadcast(spent)).filter(F.col("place") <= budget - F.col("spent")).drop("spent", "place")  # one row


def pages_written(spark: SparkSession, path: str) -> DataFrame:
    """(file, page, n) of each page of append_pages(), from the files' footers; paths that pyarrow's file systems reach."""

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyarrow import parquet as pq

        for batch in batches:
            for file in batch.column(0).to_pylist():
                files, name = fs.FileSystem.from_uri(file)
                footer = pq.read_metadata(name, filesystem=files)
                n = [footer.row_group(k).num_rows for k in range(footer.num_row_groups)]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(n), pa.string()), pa.array(range(len(n)), pa.int32()), pa.array(n, pa.int64())], names=["file", "page", "n"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    return found.mapInArrow(footers, "file string, page int, n bigint")
