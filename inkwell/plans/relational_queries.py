"""Filters, joins, aggregates, windows, paging and set operations over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import text
from inkwell.operators import upkeep
from inkwell.plans.registry import query
from inkwell.session import table


@query(
    "coverage_by_doc",
    "select l_orderkey, count(*) as n_chunks, count(*) filter (where l_returnflag = 'N') as n_pending, count(*) filter (where l_returnflag = 'N') > 0 as has_pending from lineitem group by 1",
)
def coverage_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = F.count_if(F.col("l_returnflag") == "N")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_chunks"), pending.alias("n_pending"), (pending > 0).alias("has_pending"))


@query("fully_embedded", "select l_orderkey, count(*) as n from lineitem group by 1 having count(*) > 0 and count(*) filter (where l_returnflag = 'N') = 0")
def fully_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("open"))
    return rows.filter("n > 0 and open = 0").select("l_orderkey", "n")


@query(
    "pending_flags",
    "select o_orderkey, coalesce(x.open > 0, true) as has_pending from orders left join (select l_orderkey, count(*) filter (where l_linestatus = 'O') as open from lineitem group by 1) x on l_orderkey = o_orderkey",
)
def pending_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_linestatus") == "O").alias("open"))
    return table(spark, sf_dir, "orders").join(counts, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.coalesce(F.col("open") > 0, F.lit(True)).alias("has_pending"))


@query(
    "progress_by_segment",
    """select c_mktsegment as segment, count(o_orderkey) as total, count(*) filter (where o_orderstatus = 'O') as pending,
      round(case when count(o_orderkey) = 0 then 100.0 else 100.0 * (count(o_orderkey) - count(*) filter (where o_orderstatus = 'O')) / count(o_orderkey) end, 4) as percent
    from customer left join orders on o_custkey = c_custkey group by 1""",
)
def progress_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    out = rows.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("o_orderkey").alias("total"), F.count_if(F.col("o_orderstatus") == "O").alias("pending"))
    return out.withColumn("percent", F.round(upkeep.progress(F.col("total"), F.col("pending")), 4))


@query(
    "document_counts",
    "select c_custkey, coalesce(n, 0) as n_orders, coalesce(v, 0) as total from customer left join (select o_custkey, count(*) as n, round(sum(o_totalprice), 2) as v from orders group by 1) on o_custkey = c_custkey",
)
def document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("v"))
    return table(spark, sf_dir, "customer").join(counts, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("v", F.lit(0.0)).alias("total"))


@query(
    "list_page",
    "select o_orderkey, cast(o_orderdate as date)::varchar as day, o_orderpriority, (select count(*) from orders where o_orderpriority ilike '%u%') as total from orders where o_orderpriority ilike '%u%' order by o_orderdate desc nulls last, o_orderkey limit 20 offset 40",
)
def list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit, offset = upkeep.clamped(20, 40)
    found = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").ilike("%u%"))
    total = found.agg(F.count("*").alias("total"))
    page = found.orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").offset(offset).limit(limit)
    return page.select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"), "o_orderpriority").crossJoin(F.broadcast(total))  # one row


@query(
    "sharded_page",
    """select o_orderkey, shard from (select o_orderkey, o_orderdate, case when year(o_orderdate) < 1995 then 1 when year(o_orderdate) < 1997 then 2 else 3 end as shard from orders)
    order by shard, o_orderdate asc nulls last, o_orderkey limit 50 offset 1230""",
)
def sharded_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts first; then only the shards that the page touches are read and sorted."""
    year = F.year("o_orderdate")
    rows = table(spark, sf_dir, "orders").withColumn("shard", F.when(year < 1995, 1).when(year < 1997, 2).otherwise(3))
    counts = sorted((r["shard"], r["n"]) for r in rows.groupBy("shard").agg(F.count("*").alias("n")).collect())  # a row for each shard
    pages = []
    for shard, offset, limit in upkeep.page_of_shards(counts, 1230, 50):
        pages.append(rows.filter(F.col("shard") == shard).orderBy(F.asc_nulls_last("o_orderdate"), "o_orderkey").offset(offset).limit(limit))
    out = pages[0] if pages else rows.limit(0)
    for more in pages[1:]:
        out = out.unionByName(more)
    return out.select("o_orderkey", "shard")


@query(
    "listing_order",
    r"""with d as (select o_orderkey, (o_orderkey % 900)::varchar || case when o_orderkey % 7 = 0 then '' else '/' || (1990 + o_orderkey % 30)::varchar || ' Sb.' end as ext, o_orderdate from orders),
    p as (select *, try_cast(nullif(regexp_extract(ext, '^(\d+)/', 1), '') as int) as number, try_cast(nullif(regexp_extract(ext, '^\d+/(\d{4})', 1), '') as int) as year from d)
    select o_orderkey, number, year from p order by year asc nulls last, number asc nulls last, o_orderdate desc, o_orderkey limit 100""",
)
def listing_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.concat((F.col("o_orderkey") % 900).cast("string"), F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.concat(F.lit("/"), (1990 + F.col("o_orderkey") % 30).cast("string"), F.lit(" Sb."))))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", text.act_number(ext).alias("p")).select("o_orderkey", "o_orderdate", "p.number", "p.year")
    return rows.orderBy(F.asc_nulls_last("year"), F.asc_nulls_last("number"), F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", "number", "year")


@query(
    "title_search",
    "select c_custkey, c_name from customer where c_name ilike '%00012%' or c_mktsegment ilike '%auto%'",
)
def title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter(F.col("c_name").ilike("%00012%") | F.col("c_mktsegment").ilike("%auto%")).select("c_custkey", "c_name")


@query(
    "null_safe_filters",
    """with d as (select doc_id, case when doc_id % 4 = 0 then null when doc_id % 4 = 1 then 'marker' else source end as h, case when doc_id % 3 = 0 then null else doc_id % 3 = 1 end as cur from documents)
    select doc_id, h is distinct from 'marker' as not_marker, coalesce(cur, true) as is_current from d where h is distinct from 'marker' or cur is null""",
)
def null_safe_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(d % 4 == 0, None).when(d % 4 == 1, "marker").otherwise(F.col("source")).alias("h"), F.when(d % 3 == 0, None).otherwise(d % 3 == 1).alias("cur"))
    other = ~F.col("h").eqNullSafe("marker")
    return rows.filter(other | F.col("cur").isNull()).select("doc_id", other.alias("not_marker"), F.coalesce("cur", F.lit(True)).alias("is_current"))


@query(
    "length_gates",
    """select doc_id, length(trim(text)) >= 20 as g20, length(trim(text)) >= 200 as g200, coalesce(case when length(text) % 2 = 0 and length(text) >= 50 then 'attachment' end, case when length(text) >= 200 then 'detail' end) as chosen,
      case when source = 'src0' then 5000 when source in ('src1', 'src2') then 1000 else 0 end as priority from documents""",
)
def length_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    chosen = F.coalesce(F.when((n % 2 == 0) & (n >= 50), "attachment"), F.when(n >= 200, "detail"))
    priority = F.when(F.col("source") == "src0", 5000).when(F.col("source").isin("src1", "src2"), 1000).otherwise(0)
    return table(spark, sf_dir, "documents").select("doc_id", (F.length(F.trim("text")) >= 20).alias("g20"), (F.length(F.trim("text")) >= 200).alias("g200"), chosen.alias("chosen"), priority.alias("priority"))


@query("orphans", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT' and o_orderstatus = 'O')")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'O'")
    return table(spark, sf_dir, "customer").join(children, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("not_ingested", "select doc_id from documents where upper(regexp_replace(' src' || (doc_id % 40), '\\s+', '', 'g')) not in (select upper(source) from documents)")
def not_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = docs.select(F.upper("source").alias("key")).distinct()
    new = docs.select("doc_id", text.case_number(F.concat(F.lit(" src"), (F.col("doc_id") % 40).cast("string"))).alias("key"))
    return new.join(held, "key", "left_anti").select("doc_id")


@query("pending_siblings", "select l_orderkey, l_linenumber from lineitem a where l_returnflag <> 'N' and exists (select 1 from lineitem b where b.l_orderkey = a.l_orderkey and b.l_returnflag = 'N' and b.l_linenumber <> a.l_linenumber)")
def pending_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    pending = rows.filter("l_returnflag = 'N'").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("low"), F.max("l_linenumber").alias("high"))
    # some other pending row exists iff the pending numbers aren't just this one's
    return rows.filter("l_returnflag <> 'N'").join(pending, "l_orderkey").filter("low <> l_linenumber or high <> l_linenumber").select("l_orderkey", "l_linenumber")


@query(
    "referenced_guard",
    """with d as (select o_orderkey as id, case when o_orderkey % 5 = 0 then o_orderkey - 1 end as superseded_by, case when o_orderkey % 7 = 0 then o_orderkey - 2 end as explains from orders), gone as (select id from d where id % 3 = 0)
    select g.id from gone g where not exists (select 1 from d where d.superseded_by = g.id and d.id not in (select id from gone)) and not exists (select 1 from d where d.explains = g.id and d.id not in (select id from gone))""",
)
def referenced_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 5 == 0, k - 1).alias("superseded_by"), F.when(k % 7 == 0, k - 2).alias("explains"))
    gone = rows.filter("id % 3 = 0").select("id")
    staying = rows.join(gone, "id", "left_anti")
    held = staying.select(F.explode(F.array_compact(F.array("superseded_by", "explains"))).alias("id"))
    return gone.join(held, "id", "left_anti")


@query(
    "count_integrity",
    "select a.k as l_orderkey, n_main, n_shard from (select l_orderkey as k, count(*) as n_main from lineitem group by 1) a join (select l_orderkey as k, count(*) as n_shard from lineitem where l_shipdate < timestamp '1998-06-01' group by 1) b using (k) where n_main = n_shard and n_main > 0",
)
def count_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    return upkeep.safe_to_delete(rows, rows.filter("l_shipdate < timestamp'1998-06-01'"), "l_orderkey")


@query(
    "safe_to_delete",
    """with o as (select l_orderkey as id, count(*) as n, count(*) filter (where l_returnflag = 'R') as e from lineitem group by 1), w as (select l_orderkey as id, count(*) as n, count(*) filter (where l_returnflag = 'A') as e from lineitem where l_linenumber <= 4 group by 1)
    select d.o_orderkey as id from orders d left join o on o.id = d.o_orderkey left join w on w.id = d.o_orderkey where coalesce(w.n, 0) >= coalesce(o.n, 1000000000) and coalesce(w.e, 0) >= coalesce(o.e, 0)""",
)
def safe_to_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    # old and new counts in one pass over the table
    kept = F.col("l_linenumber") <= 4
    both = rows.groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n_old"), F.count_if(F.col("l_returnflag") == "R").alias("e_old"), F.count_if(kept).alias("n_new"), F.count_if(kept & (F.col("l_returnflag") == "A")).alias("e_new"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(both, "id").filter("n_new >= n_old and e_new >= e_old").select("id")


@query("set_union", "select o_custkey as id from orders where o_orderstatus = 'F' union select o_custkey from orders where o_orderpriority = '1-URGENT'")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return rows.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).unionByName(rows.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"))).distinct()


@query("set_intersect", "select o_custkey as id from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderpriority = '1-URGENT'")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return rows.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).intersect(rows.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")))


@query("set_except", "select c_custkey as id from customer except select o_custkey from orders where o_orderpriority = '1-URGENT'")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).subtract(done)


@query("set_bag", "select lang as k, count(*) as n from (select lang from documents union all select role from conversations) group by 1")
def set_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("k")).unionByName(table(spark, sf_dir, "conversations").select(F.col("role").alias("k")))
    return rows.groupBy("k").agg(F.count("*").alias("n"))


@query(
    "later_shard_wins",
    """with u as (select o_custkey as id, o_totalprice as v, 1 as r from orders where o_orderkey % 2 = 0 union all select o_custkey, -o_totalprice, 2 from orders where o_orderkey % 2 <> 0)
    select id, round(arg_max(v, r * 1e12 + abs(v)), 2) as v from u group by id""",
)
def later_shard_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    first = rows.filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("v"), F.lit(1).alias("r"))
    second = rows.filter("o_orderkey % 2 <> 0").select(F.col("o_custkey").alias("id"), (-F.col("o_totalprice")).alias("v"), F.lit(2).alias("r"))
    return first.unionByName(second).groupBy("id").agg(F.round(F.max_by("v", F.struct("r", F.abs("v"))), 2).alias("v"))


@query("group_counts", "select c_mktsegment as organ, year(o_orderdate)::int as rok, count(*) as n, round(100.0 * count(*) filter (where o_orderstatus <> 'O') / count(*), 4) as percent from orders join customer on c_custkey = o_custkey group by 1, 2")
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return rows.groupBy(F.col("c_mktsegment").alias("organ"), F.year("o_orderdate").alias("rok")).agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(F.col("o_orderstatus") != "O") / F.count("*"), 4).alias("percent"))


@query("outcome_pivot", "pivot (select year(l_shipdate)::varchar as y, l_returnflag from lineitem) on l_returnflag in ('A', 'N', 'R') using count(*) group by y")
def outcome_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("string").alias("y"), "l_returnflag")
    return rows.groupBy("y").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1))).na.fill(0)


@query("json_rows", "select n_regionkey, n_name, to_json({'key': n_nationkey, 'name': n_name}) as row_json from nation")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_regionkey", "n_name", F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))).alias("row_json"))


@query("json_aggregate", "select r_regionkey, coalesce((select '[' || string_agg(n_nationkey::varchar, ',' order by n_nationkey) || ']' from nation where n_regionkey = r_regionkey and n_nationkey > 3), '[]') as nations from region")
def json_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "nation").filter("n_nationkey > 3").groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list("n_nationkey"))).alias("nations"))  # 25 rows
    return table(spark, sf_dir, "region").join(found, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("r_regionkey", F.coalesce("nations", F.lit("[]")).alias("nations"))


@query("nested_fields", "select event_id, coalesce((props::json ->> 'k')::int, -1) as k from events")
def nested_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(-1)).alias("k"))


@query("first_occurrence", "with r as (select doc_id, source, lang, row_number() over (partition by source, coalesce(lang, '') order by doc_id) as rn from documents) select doc_id, source, lang from r where rn = 1")
def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", F.coalesce("lang", F.lit("")).alias("lang")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "source", "lang")


@query("sibling_suffixes", "select l_orderkey, l_linenumber, l_orderkey::varchar || case when rn > 1 then '-' || rn else '' end as external_id from (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber) as rn from lineitem)")
def sibling_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rank.alias("rn"))
    return rows.select("l_orderkey", "l_linenumber", F.concat(F.col("l_orderkey").cast("string"), F.when(F.col("rn") > 1, F.concat(F.lit("-"), F.col("rn").cast("string"))).otherwise("")).alias("external_id"))


@query("cumulative_pick", "with c as (select c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by 1), r as (select *, sum(n) over (order by n desc, c_custkey rows unbounded preceding) - n as before from c) select c_custkey, n from r where before < 500")
def cumulative_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))
    return upkeep.picked(rows, "n", 500, F.desc("n"), "c_custkey").select("c_custkey", "n")


@query(
    "first_nonnull_merge",
    "select user_id, min(event_id) as first_seen, arg_min(value, event_id) filter (where value is not null and event_type = 'purchase') as purchase, arg_min(event_type, event_id) as first_type from events group by user_id",
)
def first_nonnull_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumns({"purchase": F.when(F.col("event_type") == "purchase", F.col("value")), "first_type": F.col("event_type")})
    return upkeep.first_known(rows, "user_id", "event_id", ["purchase", "first_type"])


@query(
    "miss_streak",
    """with p as (select user_id, event_id, event_type = 'purchase' as hit from events), i as (select *, sum(hit::int) over (partition by user_id order by event_id) as island from p),
    m as (select *, case when hit then 0 else sum((not hit)::int) over (partition by user_id, island order by event_id) end as misses from i), s as (select *, min(case when misses >= 12 then event_id end) over (partition by user_id) as stop from m)
    select user_id, count(*) as probed, count(*) filter (where hit) as hits, max(misses)::bigint as longest from s where stop is null or event_id <= stop group by user_id""",
)
def miss_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("hit"))
    rows = upkeep.miss_streaks(probes, "user_id", "event_id", "hit")
    return rows.groupBy("user_id").agg(F.count("*").alias("probed"), F.count_if("hit").alias("hits"), F.max("misses").cast("bigint").alias("longest"))


@query("smallest_shard", "select arg_min(s_nationkey, n * 1000 + s_nationkey) as shard, min(n) as n from (select s_nationkey, count(*) as n from supplier group by 1)")
def smallest_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    return sizes.agg(F.min_by("s_nationkey", F.struct("n", "s_nationkey")).alias("shard"), F.min("n").alias("n"))


@query("value_checks", "select count(*) filter (where l_quantity <= 0) as bad_quantity, count(*) filter (where l_discount not between 0 and 1) as bad_discount, count(*) filter (where l_returnflag not in ('A', 'N', 'R')) as bad_flag, count(*) as n from lineitem")
def value_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.count_if(F.col("l_quantity") <= 0).alias("bad_quantity"), F.count_if(~F.col("l_discount").between(0, 1)).alias("bad_discount"), F.count_if(~F.col("l_returnflag").isin("A", "N", "R")).alias("bad_flag"), F.count("*").alias("n"))


@query("quality_defaults", "select d.doc_id, coalesce(l.quality, 1) as quality, coalesce(l.toxic, 0) as toxic, l.doc_id is not null as labelled from documents d left join labels l using (doc_id)")
def quality_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("hit", F.lit(True))
    return table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"), F.coalesce("hit", F.lit(False)).alias("labelled"))


@query("secured_rows", "select event_id, user_id from events where exists (select 1 from customer where c_custkey = 3 and c_acctbal > -100000) and user_id = 3")
def secured_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_acctbal") > -100000, "approved").otherwise("pending").alias("status"))
    return upkeep.visible_to(table(spark, sf_dir, "events").filter("user_id = 3").select("event_id", "user_id"), profiles, "3")
