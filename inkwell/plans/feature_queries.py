"""Vector cells, functions that SQL calls, streamed lists, keyed streams, fills, backfills and court pages, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import embedding, tables, text
from inkwell.operators import changes, upkeep
from inkwell.operators.cells import Cells
from inkwell.operators.prefix import work_folder
from inkwell.operators.store import Store
from inkwell.plans import detail_queries, retrieval_queries, text_queries
from inkwell.plans.registry import oracle_of, query
from inkwell.session import table
from inkwell.sources import lists
from inkwell.streaming import stateful, usage


def _cells(spark: SparkSession, sf_dir: str) -> tuple[Cells, DataFrame]:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return Cells.built(rows, f"{work_folder(spark)}/cells", cells=64), rows.filter("vec_id % 100 = 0")


@query("cells_topk")
def cells_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors, approximately, of every hundredth: 40 of 64 cells are probed, as these vectors lie in all directions alike."""
    index, asked = _cells(spark, sf_dir)
    return index.search(asked, 10, probes=40).select("question", "rank", "vec_id", F.round("similarity", 6).alias("similarity"))


@query(
    "cells_exact_topk",
    """with e as (select vec_id, embedding::double[] as v from embeddings where embedding is not null),
    s as (select q.vec_id as question, e.vec_id, round(list_cosine_similarity(e.v, q.v), 12) as sim from e, e q where q.vec_id % 100 = 0),
    r as (select *, row_number() over (partition by question order by sim desc, vec_id) as rank from s)
    select question, rank::int as rank, vec_id, round(sim, 6) as similarity from r where rank <= 10""",
)
def cells_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth: few cells first, then those that could hold something better."""
    index, asked = _cells(spark, sf_dir)
    return index.search(asked, 10, probes=4, exact=True).select("question", "rank", "vec_id", F.round("similarity", 6).alias("similarity"))


@query(
    "sql_match_chunks",
    f"""with {retrieval_queries.SIMILARITY}, d as (select doc_id, source, lang, date '2020-01-01' + (doc_id % 500)::int as valid_from, case when doc_id % 3 = 0 then date '2020-12-01' end as valid_until from documents)
    select s.vec_id as chunk_id, d.doc_id as document_id, round(s.sim, 6) as similarity, d.source as doc_title, d.lang as doc_type from s join d on d.doc_id = s.vec_id
    where d.valid_from <= date '2020-10-15' and (d.valid_until is null or date '2020-10-15' <= d.valid_until) and s.sim >= 0.05 and d.lang in ('en', 'cs', 'de')
    order by s.sim desc, s.vec_id limit 12""",
)
def sql_match_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search as a function that SQL calls: named arguments, defaults, as of a day, some types."""
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 500).cast("int"))
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("title"), F.lit("u").alias("url"), F.col("lang").alias("doc_type"), F.lit(True).alias("is_current"),
        day.alias("valid_from"), F.when(F.col("doc_id") % 3 == 0, F.lit("2020-12-01").cast("date")).alias("valid_until"),
    )
    vectors = table(spark, sf_dir, "embeddings")
    chunks = vectors.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("document_id"), F.lit("h").alias("heading"), F.lit("c").alias("content"), "embedding")
    documents.createOrReplaceTempView("inkwell_documents")
    chunks.createOrReplaceTempView("inkwell_chunks")
    tables.register(spark, "inkwell_documents", "inkwell_chunks")
    asked = ", ".join(f"{x!r}d" for x in retrieval_queries.asked_vector(vectors))
    return spark.sql(
        f"""select chunk_id, document_id, round(similarity, 6) as similarity, doc_title, doc_type
        from match_chunks(array({asked}), match_count => 12, min_similarity => 0.05d, p_as_of => date'2020-10-15', p_doc_types => array('en', 'cs', 'de'))"""
    )


@query("sql_fixed_chunks", oracle_of(text_queries.chunks_fixed))
def sql_fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by a lateral call for each document."""
    table(spark, sf_dir, "documents").createOrReplaceTempView("inkwell_texts")
    tables.register(spark)
    return spark.sql("select d.doc_id, c.chunk_index, c.content from inkwell_texts d, lateral fixed_chunks(d.text, 3000) c")


@query("sql_sliding_chunks", oracle_of(text_queries.chunks_sliding))
def sql_sliding_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by a function of a whole table."""
    table(spark, sf_dir, "documents").createOrReplaceTempView("inkwell_texts")
    tables.register(spark)
    return spark.sql("select doc_id, chunk_index, left(content, 8000) as content from sliding_chunks(table(select doc_id, text from inkwell_texts), 'text', 4000)")


@query("streamed_list_items", "select doc_id, length(text) as n from documents where doc_id % 5 = 2 and doc_id < (select max(doc_id) / 2 from documents)")
def streamed_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in eight gzip JSON lists; those with wanted keys come back, and files are read no further than that."""
    folder = f"{work_folder(spark)}/lists"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # lines of JSON as the lists of documents: one large value a file
    item = F.to_json(F.struct("doc_id", "text"), {"ignoreNullFields": "false"})
    items = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(8)).alias("file"), F.lit(1).alias("part"), "doc_id", F.concat(item, F.lit(",")).alias("line"))
    ends = items.select("file").distinct()
    heads = ends.selectExpr("file", "0 as part", "cast(null as bigint) as doc_id", """'{"head": [1, {"x": []}], "položky": [' as line""")
    tails = ends.selectExpr("file", "2 as part", "cast(null as bigint) as doc_id", "'null]}' as line")
    whole = heads.unionByName(items).unionByName(tails)
    whole.repartition("file").sortWithinPartitions("file", "part", "doc_id").select("file", "line").write.option("compression", "gzip").partitionBy("file").text(folder)
    limit = docs.agg(F.max("doc_id")).first()[0] or 0
    wanted = docs.filter((F.col("doc_id") % 5 == 2) & (F.col("doc_id") < limit / 2)).select("doc_id")
    found = lists.wanted_items(spark, folder, "položky", "doc_id", "doc_id bigint, text string", wanted)
    return found.select("doc_id", F.length("text").alias("n"))


def _landed(spark: SparkSession, rows: DataFrame, folder: str, parts: int) -> DataFrame:
    """rows as files, dealt by a hash in one pass; a stream of them in `parts` micro-batches, each of a file for every core."""
    wide = spark.sparkContext.defaultParallelism
    rows.repartition(parts * wide, "event_id").write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", wide).parquet(folder)


_OP = "case when event_type = 'error' then 'delete' when event_type = 'purchase' then 'update' else 'insert' end"


@query(
    "stream_pending_chunks",
    f"""with l as (select user_id, event_id % 4 as chunk_id, arg_max({_OP}, event_id) as op, arg_max(case when value < 5 then null else value > 60 end is true, event_id) as embedded from events group by all)
    select user_id as document_id, count(*) filter (where op <> 'delete') as n_chunks, count(*) filter (where op <> 'delete' and not embedded) as n_pending, coalesce(bool_or(not embedded) filter (where op <> 'delete'), false) as pending from l group by 1""",
)
def stream_pending_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flag of documents as chunks come, are embedded and go, over three micro-batches in which events come late."""
    work = work_folder(spark)
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id as document_id", "event_id % 4 as chunk_id", "event_id as seq", f"{_OP} as op", "case when value < 5 then null else value > 60 end as embedded", "cast(ts as timestamp) as at"
    )
    before = stateful.use_rocksdb(spark)
    flags = stateful.pending_chunks(_landed(spark, rows, f"{work}/in", 3), late="400 days", keep_ms=400 * 86_400_000)
    usage.worked_off(flags, lambda df, n: df.withColumn("b", F.lit(n)).write.mode("append").parquet(f"{work}/out"), f"{work}/check", "update")
    stateful.set_back(spark, before)
    rows = spark.read.parquet(f"{work}/out")
    return rows.groupBy("document_id").agg(F.max_by(F.struct("n_chunks", "n_pending", "pending"), "b").alias("s")).select("document_id", "s.*")


@query("stream_limits", "select event_id, count(*) over (partition by user_id order by ts range between interval 24 hours preceding and current row) as in_window, count(*) over (partition by user_id order by ts range between interval 24 hours preceding and current row) <= 10 as allowed from events")
def stream_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rolling limit decided for each event, though events come in any order, over several micro-batches."""
    work = work_folder(spark)
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "cast(ts as timestamp) as at")
    last = rows.agg(F.max("at")).selectExpr("cast(-1 as bigint) as event_id", "cast(-1 as bigint) as user_id", "`max(at)` + interval 1000 days as at")
    stream = _landed(spark, rows, f"{work}/in", 4)
    last.coalesce(1).write.mode("append").parquet(f"{work}/in")  # a heartbeat: it lets the last events out
    before = stateful.use_rocksdb(spark)
    usage.worked_off(stateful.decided(stream, 10, late="60 days"), lambda df, n: df.write.mode("append").parquet(f"{work}/out"), f"{work}/check")
    stateful.set_back(spark, before)
    return spark.read.schema("event_id bigint, in_window bigint, allowed boolean").parquet(f"{work}/out").filter("event_id >= 0")


@query(
    "greedy_fill_whole",
    """with recursive r as (select o_orderkey, trunc(o_totalprice)::bigint as bytes, row_number() over (order by o_orderkey) as n from orders),
    g as (select 0::bigint as n, 90000000::bigint as a, 20000000::bigint as b, 500000::bigint as c, null::bigint as o_orderkey, -1 as shard, 0::bigint as bytes union all
      select r.n, case when g.a >= r.bytes then g.a - r.bytes else g.a end, case when g.a < r.bytes and g.b >= r.bytes then g.b - r.bytes else g.b end, case when g.a < r.bytes and g.b < r.bytes and g.c >= r.bytes then g.c - r.bytes else g.c end,
        r.o_orderkey, case when g.a >= r.bytes then 0 when g.b >= r.bytes then 1 when g.c >= r.bytes then 2 else -1 end, r.bytes from g join r on r.n = g.n + 1)
    select o_orderkey, bytes, shard::bigint as shard from g where n > 0""",
)
def greedy_fill_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows as one group: they stream through the rooms that are left."""
    rows = table(spark, sf_dir, "orders").select(F.lit(1).alias("batch"), "o_orderkey", F.col("o_totalprice").cast("bigint").alias("bytes"))
    return upkeep.greedy_fill(rows, "bytes", "o_orderkey", [90_000_000, 20_000_000, 500_000]).drop("batch")


@query(
    "backfilled_chunks",
    """with d as (select o_orderkey as id from orders where o_orderstatus = 'F' and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'A')),
    n as (select l_orderkey as document_id, l_linestatus as heading, row_number() over (partition by l_orderkey order by l_linestatus) - 1 as chunk_index from (select distinct l_orderkey, l_linestatus from lineitem where l_orderkey in (select id from d))),
    made as (select n.document_id, n.chunk_index::int as chunk_index, n.heading, string_agg(l_returnflag || l_linenumber::varchar, ' ' order by l_linenumber, l_returnflag) as content from n join lineitem l on l.l_orderkey = n.document_id and l.l_linestatus = n.heading group by all)
    select * from made union all select l_orderkey, l_linenumber::int, l_linestatus, 'had' from lineitem where l_returnflag = 'A'""",
)
def backfilled_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Historical documents without chunks get those of their sections, written into the stored table of chunks; twice, which changes nothing."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), "l_linestatus", "l_returnflag")
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") != "F").alias("is_current"))
    path = lambda *parts: F.concat_ws("/", F.lit("o"), *[F.col(p).cast("string") for p in parts])
    sections = lines.select("l_orderkey", "l_linestatus").repartition("l_orderkey").distinct()
    nodes = sections.select(F.col("l_orderkey").alias("document_id"), path("l_orderkey", "l_linestatus").alias("path"), F.col("l_linestatus").alias("heading"), F.col("l_linestatus").alias("ord"))
    fragments = lines.select(path("l_orderkey", "l_linestatus", "l_linenumber").alias("path"), F.col("l_linenumber").alias("ord"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"))
    had = lines.filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_index"), F.col("l_linestatus").alias("heading"), F.lit("had").alias("content"))
    store = Store.created(had, f"{work_folder(spark)}/chunks", "document_id", 64)
    for _ in range(2):
        made = changes.backfilled(docs, store.rows(), nodes, fragments).select("document_id", "chunk_index", "heading", "content")
        folder = work_folder(spark, "made")
        made.write.parquet(folder)  # asked twice: for its keys and for its rows
        made = spark.read.schema(made.schema).parquet(folder)
        store.changed(lambda old, made=made: old.unionByName(made), made)
    return store.rows()


_PAGE = "'<h1>x</h1><table>' || case when page_id % 3 <> 0 then '<tr><td>Spisova znacka</td> <td> ' || page_id::varchar || '/20 </td></tr>' else '' end || '<tr><td>Navrhovatel</td><td></td></tr><tr><td>Vyznam</td><td>' || url || '</td></tr></table>' || case when page_id % 7 <> 0 then 'Text dokumentu' else '' end || case when page_id % 5 = 0 then 'Vytah z dokumentu neni k dispozici' else '' end || coalesce(html, '') || case when page_id % 2 = 0 then 'Ustavni soud, Jostova 8 <b>after</b>' else '' end"
_FIELD_SQL = ", ".join(f"nullif(regexp_replace(regexp_extract(head, '{label}\\s*([^\\n]*)', 1), '^\\s+|\\s+$', '', 'g'), '') as {name}" for name, label in text.COURT_FIELDS.items())


@query(
    "court_fields",
    rf"""with p as (select page_id, {_PAGE} as page from pages), h as (select page_id, regexp_replace(left(page, strpos(page, '{text.COURT_TEXT}') - 1), '<[^>]+>', chr(10), 'g') as head, split_part(substring(page, strpos(page, '{text.COURT_TEXT}') + {len(text.COURT_TEXT)}), '{text.COURT_END}', 1) as tail from p where contains(page, '{text.COURT_TEXT}')),
    b as (select page_id, {_FIELD_SQL}, regexp_replace(regexp_replace(regexp_replace(regexp_replace(tail, '<[^>]+>', ' ', 'g'), '\s+\n', chr(10), 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g') as body from h)
    select * from b where body <> '' and not contains(body, '{text.COURT_NO_TEXT}')""",
)
def court_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirteen fields and the text of court pages, made around the given pages."""
    k = F.col("page_id")
    page = F.concat(
        F.lit("<h1>x</h1><table>"), F.when(k % 3 != 0, F.concat(F.lit("<tr><td>Spisova znacka</td> <td> "), k.cast("string"), F.lit("/20 </td></tr>"))).otherwise(""),
        F.lit("<tr><td>Navrhovatel</td><td></td></tr><tr><td>Vyznam</td><td>"), F.col("url"), F.lit("</td></tr></table>"), F.when(k % 7 != 0, text.COURT_TEXT).otherwise(""),
        F.when(k % 5 == 0, text.COURT_NO_TEXT).otherwise(""), F.coalesce("html", F.lit("")), F.when(k % 2 == 0, F.lit(f"{text.COURT_END} <b>after</b>")).otherwise(""),
    )
    return table(spark, sf_dir, "pages").select("page_id", text.court_page(page).alias("c")).filter("c is not null").select("page_id", "c.*")


@query("logged_queries", "select doc_id, lang, left(text, 200) as query_preview, doc_id % 3 = 0 as web from documents")
def logged_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches appended to a log, which keeps the beginning of what was asked and no more."""
    path = f"{work_folder(spark)}/log"
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("query"), (F.col("doc_id") % 3 == 0).alias("web"))
    changes.append_log(rows.filter("web"), path)
    changes.append_log(rows.filter("not web"), path)
    return spark.read.parquet(path)


@query("embedding_rotation", oracle_of(detail_queries.embedding_calls))
def embedding_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of embedding_calls from a service with three keys, one of which is spent from the beginning."""

    def call(key: str, texts: list[str]) -> list[tuple[int, int]]:
        if key == "spent":
            raise embedding.KeySpent
        return [(len(t), len(t.replace("e", ""))) for t in texts]

    vectors = embedding.embedded(F.col("text"), embedding.Rotation(["one", "spent", "two"], call))
    return table(spark, sf_dir, "documents").select("doc_id", vectors.alias("vector"))
