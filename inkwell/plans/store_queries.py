"""Queries over stored tables: changes that rewrite a few buckets, versions that are restored, moves checked by digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import changes, digests, versions
from inkwell.operators.prefix import work_folder
from inkwell.operators.store import Store
from inkwell.plans.registry import query
from inkwell.session import table

BUCKETS = 64
_ORDER = "o_orderkey::bigint as o_orderkey, o_custkey::bigint as o_custkey, o_orderstatus, o_totalprice::double as o_totalprice"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return rows.select(F.col("o_orderkey").cast("bigint"), F.col("o_custkey").cast("bigint"), "o_orderstatus", F.col("o_totalprice").cast("double"))


@query(
    "store_merge",
    f"""with o as (select {_ORDER} from orders)
    select o_orderkey, o_custkey, case when o_orderkey % 100 = 7 then 'X' else o_orderstatus end as o_orderstatus, case when o_orderkey % 100 = 7 then o_totalprice + 1 else o_totalprice end as o_totalprice from o
    union all select -o_orderkey, 5, 'N', 0.5 from o where o_orderkey % 1000 = 1""",
)
def store_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundredth of the orders changes (two columns; a third keeps what it has), some come in: the table read back."""
    orders = _orders(spark, sf_dir)
    store = Store.created(orders, f"{work_folder(spark)}/orders", "o_orderkey", BUCKETS)
    seen = orders.filter("o_orderkey % 100 = 7").withColumns({"o_custkey": F.lit(-1).cast("bigint"), "o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") + 1})
    fresh = orders.filter("o_orderkey % 1000 = 1").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit(5).cast("bigint").alias("o_custkey"), F.lit("N").alias("o_orderstatus"), F.lit(0.5).alias("o_totalprice"))
    new = seen.unionByName(fresh)
    store.changed(lambda old: versions.merged(old, new, "o_orderkey", ["o_orderstatus", "o_totalprice"]), new)
    return store.rows()


_DOCS = "doc_id, text, coalesce(source, '?') as source"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce("source", F.lit("?")).alias("source"))


@query(
    "store_changes",
    f"""with o as (select {_DOCS}, true as is_current, null::timestamp as fetched_at from documents where doc_id % 7 <> 3),
    n as (select {_DOCS} from documents where doc_id % 50 = 3)
    select * replace (case when doc_id % 50 = 3 then 'seen' else source end as source, case when doc_id % 50 = 3 then timestamp '2024-05-01 10:00:00' end as fetched_at) from o where doc_id % 60 <> 11
    union all select * replace ('seen' as source), true, timestamp '2024-05-01 10:00:00' from n where doc_id % 7 = 3 and doc_id % 60 <> 11
    union all select {_DOCS}, true, null from documents where doc_id % 7 = 3 and doc_id % 50 <> 3 and doc_id % 9 = 1 and doc_id % 60 <> 11""",
)
def store_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refresh, an insert that never overwrites and a deletion, one after another, each in the buckets that it meets."""
    docs = _documents(spark, sf_dir).withColumns({"is_current": F.lit(True), "fetched_at": F.lit(None).cast("timestamp")})
    store = Store.created(docs.filter("doc_id % 7 <> 3"), f"{work_folder(spark)}/documents", "doc_id", BUCKETS)
    seen = docs.filter("doc_id % 50 = 3").withColumn("source", F.lit("seen"))
    store.changed(lambda old: changes.refreshed(old, seen, "doc_id", ["source"], "2024-05-01 10:00:00"), seen)
    store.prune(keep=1)  # no one reads the versions between
    offered = docs.filter("doc_id % 9 = 1")
    store.changed(lambda old: versions.first_write_wins(old, offered, "doc_id"), offered)
    store.prune(keep=1)
    gone = docs.filter("doc_id % 60 = 11").select("doc_id")
    store.changed(lambda old: old.join(gone, "doc_id", "left_anti"), gone)
    return store.rows()


@query(
    "store_backups",
    f"""with c as (select {_DOCS} from documents), r as (select unnest(range(2, 6)) as run),
    s as (select run, doc_id, case when doc_id % 400 = 1 and run >= 3 then text || '*' || run::varchar else text end as text, source from c, r where run < 5 or doc_id % 400 <> 2)
    select run, source, count(*) as n, sum(length(text))::bigint as chars, min(md5(text)) as least from s group by 1, 2""",
)
def store_backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five runs of a backup, of which four are kept: each restored, by source. Runs share the buckets that didn't change."""
    rows = _documents(spark, sf_dir)
    store = Store.created(rows, f"{work_folder(spark)}/backup", "doc_id", BUCKETS)
    marked = lambda run: rows.withColumn("text", F.when(F.col("doc_id") % 400 == 1, F.concat("text", F.lit(f"*{run}"))).otherwise(F.col("text")))
    for run in (rows, marked(3), marked(4), marked(5).filter("doc_id % 400 <> 2")):
        store.becomes(run)
    store.prune(keep=4)
    runs = None
    for version in store.versions():
        one = store.rows(version).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.min(F.md5("text")).alias("least")).withColumn("run", F.lit(version).cast("bigint"))
        runs = one if runs is None else runs.unionByName(one)
    return runs


@query(
    "verified_moves",
    """select coalesce(source, '?') as source, count(*) as n_left, count(*) as n_right, count(*) filter (where doc_id % 97 = 5 and text is not null and text <> '') = 0 as equal from documents group by 1""",
)
def verified_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards and their copies compared by sums: as many rows on both sides, but in some a text lacks its last character."""
    docs = table(spark, sf_dir, "documents").withColumn("source", F.coalesce("source", F.lit("?")))
    whole = F.col("text")
    copied = docs.withColumn("text", F.when(F.col("doc_id") % 97 == 5, F.left(whole, F.length(whole) - 1)).otherwise(whole)).repartition(5)
    first = digests.digests(copied.filter("doc_id % 2 = 0"), "source")
    later = digests.digests(copied.filter("doc_id % 2 <> 0"), "source")
    return digests.compared(digests.digests(docs, "source"), digests.added(first, later, by=["source"]), "source")


@query(
    "store_versions",
    """with live as (select doc_id as doc, 'd' || doc_id as id, case when doc_id % 6 = 0 then null else 'v/' || lang end as version from documents where doc_id % 4 <> 0),
    new as (select doc_id as doc, 'd' || doc_id as id, case when doc_id % 3 = 0 then 'v/' || lang || '/2' else 'v/' || lang end as version from documents where doc_id % 5 <> 0 and doc_id % 7 <> 0),
    ch as (select l.doc, l.id, l.version as old, n.version as new from live l join new n using (id) where l.version is distinct from n.version)
    select doc, id, version, true as is_current, 'platny' as status, null as superseded_by from live where id not in (select id from ch)
    union all select doc, id || '#hist-' || coalesce(right(old, 40), sha1(concat_ws('|', id, old, 'true', 'platny'))), old, false, 'historicky', id from ch
    union all select doc, id, new, true, 'platny', null from ch
    union all select doc, id, version, true, 'platny', null from new where id not in (select id from live)""",
)
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions roll over in a stored table: what has a new version with content is archived as it was and begins anew; done twice, once counts."""
    d, docs = F.col("doc_id"), table(spark, sf_dir, "documents")
    key, of = F.concat(F.lit("d"), d.cast("string")).alias("id"), F.concat(F.lit("v/"), "lang")
    columns = [F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_until"), F.lit(True).alias("is_current"), F.lit("platny").alias("status"), F.lit(None).cast("string").alias("superseded_by")]
    live = docs.filter("doc_id % 4 <> 0").select(d.alias("doc"), key, F.when(d % 6 == 0, None).otherwise(of).alias("version"), *columns)
    seen = docs.filter("doc_id % 5 <> 0")
    new = seen.select(key, F.when(d % 3 == 0, F.concat(of, F.lit("/2"))).otherwise(of).alias("version"), F.lit(None).cast("date").alias("valid_from"))
    counts = seen.select(key, (d % 7).alias("n"))
    store = Store.created(live, f"{work_folder(spark)}/versions", "doc", BUCKETS)

    def roll(old: DataFrame) -> DataFrame:
        rolled = versions.rolled(old.drop("doc"), new, "id", "version", "2026-01-01", content_counts=counts)
        return rolled.withColumn("doc", F.regexp_extract("id", r"^d(-?\d+)", 1).cast("bigint"))

    for _ in range(2):
        store.changed(roll, seen.select(d.alias("doc")), name="2026-01-01")
    return store.rows().select("doc", "id", "version", "is_current", "status", "superseded_by")
