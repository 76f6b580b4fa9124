"""Versions, shards, queues, quotas and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import upkeep, versions
from inkwell.plans.registry import query
from inkwell.session import table


@query(
    "version_diff",
    """with o as (select doc_id, case when doc_id % 10 = 0 then null else md5(lang) end as v from documents where doc_id % 7 <> 0), n as (select doc_id, case when doc_id % 10 = 0 then null when doc_id % 3 = 0 then md5(source) else md5(lang) end as v from documents where doc_id % 5 <> 0)
    select n.doc_id, case when o.doc_id is null then 'inserted' when o.v is not distinct from n.v then 'unchanged' else 'changed' end as outcome from n left join o using (doc_id)""",
)
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, docs = F.col("doc_id"), table(spark, sf_dir, "documents")
    old = docs.filter("doc_id % 7 <> 0").select("doc_id", F.when(d % 10 == 0, None).otherwise(F.md5("lang")).alias("v"))
    new = docs.filter("doc_id % 5 <> 0").select("doc_id", F.when(d % 10 == 0, None).when(d % 3 == 0, F.md5("source")).otherwise(F.md5("lang")).alias("v"))
    return versions.classified(old, new, "doc_id", "v")


@query(
    "scd2_intervals",
    "select o_orderkey, o_custkey, cast(o_orderdate::date as varchar) as valid_from, cast(lead(o_orderdate::date) over w - 1 as varchar) as valid_until, lead(o_orderdate) over w is null as is_current from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)",
)
def scd2_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = versions.intervals(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey")
    return rows.select("o_orderkey", "o_custkey", F.col("valid_from").cast("string"), F.col("valid_until").cast("string"), "is_current")


@query(
    "scd2_roll",
    """with live as (select 'd' || doc_id as id, case when doc_id % 6 = 0 then null else 'v/' || lang end as version from documents where doc_id % 4 <> 0), new as (select 'd' || doc_id as id, case when doc_id % 3 = 0 then 'v/' || lang || '/2' else 'v/' || lang end as version from documents where doc_id % 5 <> 0),
    ch as (select l.id, l.version as old, n.version as new from live l join new n using (id) where l.version is distinct from n.version)
    select id, version, true as is_current, 'platny' as status, null as superseded_by from live where id not in (select id from ch)
    union all select id || '#hist-' || right(coalesce(old, ''), 40), old, false, 'historicky', id from ch
    union all select id, new, true, 'platny', null from ch
    union all select id, version, true, 'platny', null from new where id not in (select id from live)""",
)
def scd2_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, docs = F.col("doc_id"), table(spark, sf_dir, "documents")
    key = F.concat(F.lit("d"), d.cast("string")).alias("id")
    of = F.concat(F.lit("v/"), "lang")
    live = docs.filter("doc_id % 4 <> 0").select(key, F.when(d % 6 == 0, None).otherwise(of).alias("version"), F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_until"), F.lit(True).alias("is_current"), F.lit("platny").alias("status"), F.lit(None).cast("string").alias("superseded_by"))
    new = docs.filter("doc_id % 5 <> 0").select(key, F.when(d % 3 == 0, F.concat(of, F.lit("/2"))).otherwise(of).alias("version"), F.lit(None).cast("date").alias("valid_from"))
    return versions.rolled(live, new, "id", "version", "2026-01-01", told_apart=False).select("id", "version", "is_current", "status", "superseded_by")


@query(
    "embedding_reuse",
    """with o as (select l_orderkey, l_linenumber, case when l_linenumber % 2 = 0 then l_returnflag end as heading, l_linestatus as content, l_quantity as emb from lineitem), n as (select * exclude (emb) from o where l_linenumber <= 3),
    d as (select l_orderkey, heading, content, arg_max(emb, l_linenumber * 1000 + emb) as reused from o group by 1, 2, 3)
    select n.l_orderkey as document_id, n.l_linenumber as chunk_index, d.reused as embedding from n left join d on n.l_orderkey = d.l_orderkey and n.heading is not distinct from d.heading and n.content = d.content""",
)
def embedding_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_index"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("heading"), F.col("l_linestatus").alias("content"), F.col("l_quantity").alias("embedding"))
    new = rows.filter("chunk_index <= 3").drop("embedding")
    return versions.reused_embeddings(rows, new).select("document_id", "chunk_index", "embedding")


@query(
    "merge_upsert",
    "select n_nationkey, case when n_nationkey % 3 = 0 then upper(n_name) || '!' else n_name end as n_name, n_regionkey from nation union all select 100, 'NEW', 1",
)
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "nation")
    new = old.filter("n_nationkey % 3 = 0").withColumns({"n_name": F.concat(F.upper("n_name"), F.lit("!")), "n_regionkey": F.lit(9)}).unionByName(spark.createDataFrame([(100, "NEW", 1)], "n_nationkey int, n_name string, n_regionkey int"))
    return versions.merged(old, new, "n_nationkey", ["n_name"])


@query("first_write_wins", "select n_nationkey, n_name, n_regionkey from nation union all select 100, 'NEW', 1")
def first_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "nation")
    return versions.first_write_wins(old, spark.createDataFrame([(100, "NEW", 1), (3, "IGNORED", 1)], "n_nationkey int, n_name string, n_regionkey int"), "n_nationkey")


@query("replace_upsert", "select n_nationkey, case when n_nationkey = 3 then 'USED' else n_name end as n_name, case when n_nationkey = 3 then 1 else n_regionkey end as n_regionkey from nation union all select 100, 'NEW', 1")
def replace_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.upserted(table(spark, sf_dir, "nation"), spark.createDataFrame([(100, "NEW", 1), (3, "USED", 1)], "n_nationkey int, n_name string, n_regionkey int"), "n_nationkey")


@query("shrink_warnings", "with a as (select l_orderkey as id, count(*) as n_old, count(*) filter (where l_returnflag = 'R') as n_new from lineitem group by 1) select id, n_old, n_new, n_old >= 5 and n_new < 0.3 * n_old as warn from a where n_new > 0")
def shrink_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    old = rows.groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"))
    new = rows.filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"))
    return versions.shrunk(old, new, "id")


@query(
    "shard_route",
    "select case when y is null then '2021_dosud' when y < 1998 then 'do1997' when y < 2008 then '1998_2007' when y < 2021 then '2008_2020' else '2021_dosud' end as shard, count(*) as n from (select case when o_orderkey % 50 = 0 then null else year(o_orderdate) + o_orderkey % 30 end as y from orders) group by 1",
)
def shard_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.when(F.col("o_orderkey") % 50 == 0, None).otherwise(F.year("o_orderdate") + F.col("o_orderkey") % 30)
    return table(spark, sf_dir, "orders").groupBy(upkeep.year_shard(year).alias("shard")).agg(F.count("*").alias("n"))


@query(
    "budget_fill",
    "with c as (select doc_id, source, (length(text) // 3000 + 1) * 2800 as bytes from documents), r as (select *, coalesce(sum(bytes) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as before from c) select doc_id, bytes, floor(before / 50000)::bigint as shard from r",
)
def budget_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", ((F.floor(F.length("text") / 3000) + 1) * upkeep.BYTES_PER_CHUNK).cast("bigint").alias("bytes"))
    return upkeep.running_fill(rows, F.col("bytes"), "doc_id", budget=50_000, group=["source"]).select("doc_id", "bytes", "shard")


@query(
    "greedy_fill",
    """with recursive r as (select year(o_orderdate)::int as batch, o_orderkey, trunc(o_totalprice)::bigint as bytes, row_number() over (partition by year(o_orderdate) order by o_orderkey) as n from orders),
    g as (select distinct batch, 0::bigint as n, 2000000::bigint as a, 1000000::bigint as b, 500000::bigint as c, null::bigint as o_orderkey, -1 as shard, 0::bigint as bytes from r union all
      select r.batch, r.n, case when g.a >= r.bytes then g.a - r.bytes else g.a end, case when g.a < r.bytes and g.b >= r.bytes then g.b - r.bytes else g.b end, case when g.a < r.bytes and g.b < r.bytes and g.c >= r.bytes then g.c - r.bytes else g.c end,
        r.o_orderkey, case when g.a >= r.bytes then 0 when g.b >= r.bytes then 1 when g.c >= r.bytes then 2 else -1 end, r.bytes from g join r on r.batch = g.batch and r.n = g.n + 1)
    select batch, o_orderkey, bytes, shard::bigint as shard from g where n > 0""",
)
def greedy_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("batch"), "o_orderkey", F.col("o_totalprice").cast("bigint").alias("bytes"))
    return upkeep.greedy_fill(rows, "bytes", "o_orderkey", [2_000_000, 1_000_000, 500_000])


@query(
    "rebalance_pick",
    """with c as (select o_custkey as id, count(*) as n, count(*) filter (where o_orderstatus = 'F') as emb from orders group by 1), r as (select *, sum(n) over (order by emb, n desc, id rows unbounded preceding) - n as before from c where emb < 8)
    select id, n, emb from r where before < 300""",
)
def rebalance_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("emb")).filter("emb < 8")
    return upkeep.picked(rows, "n", 300, "emb", F.desc("n"), "id")


@query("weighted_schedule", "select r_name as key, turn::int as turn, row_number() over (order by r_name, turn) as slot from (select r_name, unnest(range(1, r_regionkey + 1)) as turn from region)")
def weighted_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = table(spark, sf_dir, "region").select(F.col("r_name").alias("key"), F.col("r_regionkey").alias("weight"))
    return upkeep.schedule(weights).select("key", "turn", F.col("slot").cast("bigint"))


@query(
    "queue_rounds",
    "select o_orderkey, ceil(row_number() over (partition by o_orderpriority order by o_orderdate, o_orderkey) / (10.0 * left(o_orderpriority, 1)::int))::bigint as round from orders",
)
def queue_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return upkeep.rounds(rows, "o_orderpriority", F.substring("o_orderpriority", 1, 1).cast("int"), 10, "o_orderdate", "o_orderkey").select("o_orderkey", "round")


@query(
    "pending_queue_main",
    "select o_orderkey as id from orders where o_orderstatus = 'O' order by case when o_orderkey % 4 = 0 then null else o_orderkey % 9 end desc nulls last, o_orderdate, o_orderkey limit 50",
)
def pending_queue_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    queue = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(k.alias("id"), F.when(k % 4 == 0, None).otherwise(k % 9).alias("embed_priority"), F.col("o_orderdate").alias("created_at"))
    return queue.orderBy(*upkeep.pending_main(queue)).limit(50).select("id")


@query(
    "pending_queue_shard",
    """with q as (select o_orderkey as id, o_orderkey % 2 = 0 as is_current, case when o_orderkey % 4 = 0 then null else o_orderkey % 9 end as p, case when o_orderkey % 3 = 0 then null else o_orderdate end as vu, case when o_orderkey % 5 = 0 then null else o_orderdate - interval 1 year end as vf, o_orderdate from orders)
    select id from q order by is_current desc, p desc nulls last, coalesce(vu, vf) desc nulls last, o_orderdate, id limit 50""",
)
def pending_queue_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    queue = table(spark, sf_dir, "orders").select(k.alias("id"), (k % 2 == 0).alias("is_current"), F.when(k % 4 == 0, None).otherwise(k % 9).alias("embed_priority"), F.when(k % 3 == 0, None).otherwise(day).alias("valid_until"), F.when(k % 5 == 0, None).otherwise(day - F.expr("interval 1 year")).alias("valid_from"), day.alias("created_at"))
    return queue.orderBy(*upkeep.pending_shard(queue)).limit(50).select("id")


@query("key_rotation", "select event_id, ((row_number() over (order by event_id) - 1) % 7)::bigint as key_no from events where event_type = 'error'")
def key_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id")
    return upkeep.rotated(rows, 7, "event_id").select("event_id", F.col("key_no").cast("bigint"))


@query("rolling_24h", "select event_id, count(*) over (partition by user_id order by ts range between interval 24 hours preceding and current row) as in_window, count(*) over (partition by user_id order by ts range between interval 24 hours preceding and current row) > 10 as over_limit from events")
def rolling_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.rolling_count(table(spark, sf_dir, "events"), "user_id", "ts").select("event_id", "in_window", (F.col("in_window") > 10).alias("over_limit"))


@query("daily_quota", "select user_id, cast(ts::date as varchar) as day, count(*) as n, sum(count(*)) over (partition by user_id order by ts::date)::bigint as total, sum(count(*)) over (partition by user_id order by ts::date) > 20 as over_trial from events group by user_id, ts::date")
def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    return upkeep.used_up(daily, "user_id", "d", "n", 20).select("user_id", F.col("d").cast("string").alias("day"), "n", "total", "over_trial")


@query(
    "limit_estimate",
    """with recursive d as (select event_type as k, ts::date as day, count(*) as n, row_number() over (partition by event_type order by ts::date) as i from events group by 1, 2),
    e as (select k, i, n::double as v from d where i = 1 union all select d.k, d.i, (e.v + d.n) / 2 from e join d on d.k = e.k and d.i = e.i + 1) select k, round(arg_max(v, i), 6) as estimate from e group by k""",
)
def limit_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("k"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    lists = daily.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("day", "n"))).alias("days"))  # a number for each day
    return lists.select("k", F.round(upkeep.smoothed_limit(F.transform("days", lambda x: x["n"])), 6).alias("estimate"))


@query("quota_caps", "select event_type as key, count(*) as count, count(*) <= case event_type when 'error' then 0.1 when 'view' then 0.9 else 1.0 end * 3000 or event_type = 'signup' as allowed from events group by 1")
def quota_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key")).agg(F.count("*").alias("count"))
    limits = counts.filter("key <> 'signup'").select("key", F.lit(3000).alias("limit"))
    return upkeep.within_quota(counts, {"error": 0.1, "view": 0.9}, limits).select("key", "count", "allowed")


@query(
    "failure_cache",
    "select distinct user_id from events where user_id not in (select user_id from events where event_type = 'error' and ts >= timestamp '2024-01-31 00:00:00' - interval 10 days)",
)
def failure_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    log = events.filter("event_type = 'error'").select("user_id", F.col("ts").alias("checked_at"))
    return upkeep.unchecked(events.select("user_id").distinct(), log, "user_id", "checked_at", "2024-01-31 00:00:00", 10)


@query(
    "request_resolution",
    "select c_custkey as id, case when exists (select 1 from orders where o_custkey = c_custkey) then 'fetched' when c_acctbal < 0 then 'not_found' else 'pending' end as status from customer",
)
def request_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") < 0).alias("tried"))
    return upkeep.resolved(requests, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), "id", "tried").select("id", "status")


@query("backup_retention", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as rn from orders) where rn > 4")
def backup_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.outdated(table(spark, sf_dir, "orders"), "o_custkey", F.desc("o_orderdate"), "o_orderkey").select("o_custkey", "o_orderkey")


@query(
    "privilege_guard",
    "select c_custkey, case when c_custkey % 2 = 0 then 'approved' else c_mktsegment end as status, c_name || '*' as name from customer",
)
def privilege_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("status"), F.col("c_name").alias("name"))
    new = old.withColumns({"status": F.lit("approved"), "name": F.concat("name", F.lit("*"))})
    return upkeep.guarded(old, new, "c_custkey", ["status"], F.col("c_custkey") % 2 == 0)


@query(
    "usage_by_type",
    "select event_type, cast(date_trunc('day', ts) as date)::varchar as day, count(*) as n, count(distinct user_id) as users, round(sum(value), 4) as total from events group by 1, 2",
)
def usage_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))
