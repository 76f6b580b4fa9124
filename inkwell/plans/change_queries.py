"""Changes to stored rows, mappings, reports and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import mappings
from inkwell.operators import changes, upkeep, versions
from inkwell.operators.prefix import work_folder
from inkwell.plans.registry import query
from inkwell.session import table

NOW = "2026-01-02 03:04:05"


def _cases(table_: dict[str, str], of: str, other: str | None) -> str:
    """A CASE of SQL over the entries of a mapping."""
    quoted = lambda x: "null" if x is None else "'" + x.replace("'", "''") + "'"
    return f"case {of} " + " ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in table_.items()) + f" else {quoted(other)} end"


@query(
    "refresh_seen",
    f"""with o as (select o_orderkey as id, o_orderpriority as title, o_orderkey % 3 = 0 as is_current, o_orderdate as fetched_at from orders where o_orderkey % 4 <> 0),
    n as (select o_orderkey as id, o_orderstatus as title from orders where o_orderkey % 5 < 2)
    select coalesce(o.id, n.id) as id, case when n.id is not null then n.title else o.title end as title, case when n.id is not null then true else o.is_current end as is_current,
      case when n.id is not null then '{NOW}' else strftime(o.fetched_at, '%Y-%m-%d %H:%M:%S') end as fetched_at from o full join n on o.id = n.id""",
)
def refresh_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, rows = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    old = rows.filter("o_orderkey % 4 <> 0").select(k.alias("id"), F.col("o_orderpriority").alias("title"), (k % 3 == 0).alias("is_current"), F.col("o_orderdate").cast("timestamp").alias("fetched_at"))
    new = rows.filter("o_orderkey % 5 < 2").select(k.alias("id"), F.col("o_orderstatus").alias("title"))
    return changes.refreshed(old, new, "id", ["title"], NOW).withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss"))


_GATED_SQL = """o as (select doc_id as id, coalesce(text, '') as content, sha256(coalesce(text, '')) as content_hash, true as is_embedded, null as updated_at from documents where doc_id % 4 <> 0),
    n as (select doc_id as id, coalesce(text, '') || case when doc_id % 3 = 0 then '!' else '' end as content from documents where doc_id % 5 <> 0),
    c as (select n.id, n.content from n left join o on o.id = n.id where o.id is null or o.content_hash <> sha256(n.content))"""


def _gated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d, body, docs = F.col("doc_id"), F.coalesce("text", F.lit("")), table(spark, sf_dir, "documents")
    old = docs.filter("doc_id % 4 <> 0").select(d.alias("id"), body.alias("content"), F.sha2(F.encode(body, "UTF-8"), 256).alias("content_hash"), F.lit(True).alias("is_embedded"), F.lit(None).cast("timestamp").alias("updated_at"))
    new = docs.filter("doc_id % 5 <> 0").select(d.alias("id"), F.concat(body, F.when(d % 3 == 0, "!").otherwise("")).alias("content"))
    chunks = docs.select(d.alias("document_id"), F.posexplode(F.array(F.lit("a"), F.col("lang"))).alias("chunk_index", "part"))
    return changes.hash_gated(old, chunks, new, "id", NOW)


@query("hash_gated_documents", f"""with {_GATED_SQL} select id, md5(content) as content, content_hash, is_embedded, updated_at from o where id not in (select id from c) union all select id, md5(content), sha256(content), false, '{NOW}' from c""")
def hash_gated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir)[0].select("id", F.md5("content").alias("content"), "content_hash", "is_embedded", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query("hash_gated_chunks", f"""with {_GATED_SQL} select doc_id as document_id, i as chunk_index, part from (select doc_id, 0 as i, 'a' as part from documents union all select doc_id, 1, lang from documents) where doc_id not in (select id from c)""")
def hash_gated_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir)[1].select("document_id", "chunk_index", "part")


def _deletion(spark: SparkSession, sf_dir: str, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    ids = orders.filter("o_orderstatus = 'F' and o_orderkey % 3 = 0").select("o_orderkey")
    return changes.deleted(orders, lines, ids, "o_orderkey", "l_orderkey", **how)


@query(
    "delete_parents",
    """with g as (select o_orderkey from orders where o_orderstatus = 'F' and o_orderkey % 3 = 0)
    select 'parent' as side, o_orderkey as key, count(*) as n from orders where o_orderkey not in (select * from g) group by all union all
    select 'child', l_orderkey, count(*) from lineitem where l_orderkey not in (select * from g) group by all""",
)
def delete_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents, children, _ = _deletion(spark, sf_dir, dry_run=False, confirmed=True)
    both = parents.select(F.lit("parent").alias("side"), F.col("o_orderkey").alias("key")).unionByName(children.select(F.lit("child").alias("side"), F.col("l_orderkey").alias("key")))
    return both.groupBy("side", "key").agg(F.count("*").alias("n"))


@query(
    "delete_dry_run",
    """with g as (select o_orderkey from orders where o_orderstatus = 'F' and o_orderkey % 3 = 0)
    select (select count(*) from g) as n_parents, (select count(*) from lineitem where l_orderkey in (select * from g)) as n_children, false as done, (select count(*) from orders) as left_parents, (select count(*) from lineitem) as left_children""",
)
def delete_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key of two: counts are given and nothing goes."""
    parents, children, counts = _deletion(spark, sf_dir, dry_run=False)
    left = parents.agg(F.count("*").alias("left_parents")).crossJoin(children.agg(F.count("*").alias("left_children")))  # one row each
    return counts.crossJoin(left)


@query(
    "drop_unembedded",
    "select l_orderkey, l_linenumber from lineitem where not (l_orderkey in (select o_orderkey from orders where o_orderstatus = 'O') and l_returnflag = 'N')",
)
def drop_unembedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("embedding"))
    ids = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_orderkey")
    return changes.without_unembedded(chunks, ids, "o_orderkey", "l_orderkey").select("l_orderkey", "l_linenumber")


@query("flag_listed", "select c_custkey, case when c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT') then true else c_acctbal < 0 end as migrated from customer")
def flag_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") < 0).alias("migrated"))
    ids = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return changes.flagged(rows, ids, "c_custkey", "migrated")


def _offload(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d, docs = F.col("doc_id"), table(spark, sf_dir, "documents")
    chunks = docs.select(d.alias("id"), F.when(d % 7 != 0, F.md5("text")).alias("content"), F.when(d % 7 == 0, True).when(d % 2 == 0, False).alias("content_migrated"))
    return changes.offloaded(chunks, docs.filter("doc_id % 3 <> 1").select(d.alias("id")))


_OFFLOAD = "c as (select doc_id as id, case when doc_id % 7 <> 0 then md5(text) end as content, case when doc_id % 7 = 0 then true when doc_id % 2 = 0 then false end as migrated, doc_id % 3 <> 1 as up from documents)"


@query("offload_rows", f"with {_OFFLOAD} select id, case when up and not coalesce(migrated, false) then null else content end as content, case when up and not coalesce(migrated, false) then true else migrated end as content_migrated from c")
def offload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offload(spark, sf_dir)[0]


@query("offload_moved", f"with {_OFFLOAD}, m as (select * from c where up and not coalesce(migrated, false)) select id, content, (select count(*) from m) as n from m")
def offload_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, moved, count = _offload(spark, sf_dir)
    return moved.crossJoin(F.broadcast(count))  # one row


@query("append_pages", "select count(*) as n_rows, true as small from lineitem")
def append_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written in pages of 500 rows and read back."""
    path = f"{work_folder(spark)}/pages"
    changes.append_pages(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), path)
    return changes.pages_written(spark, path).agg(F.sum("n").alias("n_rows"), (F.max("n") <= 500).alias("small"))


@query("appended_rows", "select l_orderkey, l_linenumber, l_returnflag, round(l_extendedprice, 2) as price from lineitem")
def appended_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to one table, in pages of 500 rows: every row is there, once."""
    path = f"{work_folder(spark)}/pages"
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.round("l_extendedprice", 2).alias("price"))
    changes.append_pages(rows.filter("l_orderkey % 2 = 0"), path)
    changes.append_pages(rows.filter("l_orderkey % 2 <> 0"), path)
    return spark.read.parquet(path)


_ARCHIVE = """d as (select o_orderkey as id, o_orderkey::varchar || case when o_orderkey % 3 = 0 then '#hist-a' else '' end as external_id, o_orderstatus as status from orders),
    a as (select -o_orderkey as id, o_orderkey::varchar || '#hist-a' as external_id, 'historicky' as status from orders where o_orderkey % 2 = 0),
    e as (select d.* from d where external_id in (select external_id from a))"""


def _archive(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, orders = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    text = k.cast("string")
    docs = orders.select(k.alias("id"), F.concat(text, F.when(k % 3 == 0, "#hist-a").otherwise("")).alias("external_id"), F.col("o_orderstatus").alias("status"))
    archive = orders.filter("o_orderkey % 2 = 0").select((-k).alias("id"), F.concat(text, F.lit("#hist-a")).alias("external_id"), F.lit("historicky").alias("status"))
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), "l_linenumber")
    return changes.archived(docs, chunks, archive, "external_id", "id")


@query("archive_documents", f"with {_ARCHIVE} select * from d union all select * from a where external_id not in (select external_id from d)")
def archive_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _archive(spark, sf_dir)[0]


@query("archive_chunks", f"with {_ARCHIVE} select l_orderkey as document_id, l_linenumber from lineitem where l_orderkey not in (select id from e)")
def archive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _archive(spark, sf_dir)[1]


@query(
    "archive_known_versions",
    """with l as (select o_orderkey::varchar as key, case when o_orderkey % 4 <> 0 then 'iri/' || md5(o_orderpriority) || o_orderstatus || '/x' end as v from orders where o_orderstatus <> 'P'),
    n as (select o_orderkey::varchar as key, 'iri/' || md5(o_orderpriority) || case when o_orderkey % 3 = 0 then 'N' else o_orderstatus end || '/x' as v from orders),
    b as (select l.key, l.v, n.v as nv, l.v is distinct from n.v as changed from l join n using (key))
    select key, v, true as is_current from b where not changed union all select key || '#hist-' || right(v, 40), v, false from b where changed and v is not null
    union all select key, nv, true from b where changed union all select key, v, true from n where key not in (select key from l)""",
)
def archive_known_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, orders = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    iri = lambda end: F.concat(F.lit("iri/"), F.md5("o_orderpriority"), end, F.lit("/x"))
    nulls = {c: F.lit(None).cast(t) for c, t in (("valid_from", "date"), ("valid_until", "date"), ("status", "string"), ("superseded_by", "string"))}
    live = orders.filter("o_orderstatus <> 'P'").select(k.cast("string").alias("key"), F.when(k % 4 != 0, iri(F.col("o_orderstatus"))).alias("v"), F.lit(True).alias("is_current")).withColumns(nulls)
    new = orders.select(k.cast("string").alias("key"), iri(F.when(k % 3 == 0, "N").otherwise(F.col("o_orderstatus"))).alias("v"), F.lit(None).cast("date").alias("valid_from"))
    return versions.rolled(live, new, "key", "v", "2026-01-01", known_only=True).select("key", "v", "is_current")


@query(
    "title_supersession",
    r"""with d as (select doc_id as id, 'Stanovisko CHJ č. ' || (doc_id % 50)::varchar || '/' || (2010 + doc_id % 3)::varchar || case when doc_id % 7 = 0 then ' (původně stanovisko č.' || (doc_id % 45)::varchar || ' / 2011)' else '' end as title, date '2020-01-01' + (doc_id % 90)::int as published, doc_id % 11 <> 0 as cur from documents),
    r as (select id, published, regexp_extract(title, 'původn[ěe][^0-9]{0,40}č\.?\s*(\d+[a-z]?)\s*/\s*(\d{4})', ['a', 'b']) as x from d), b as (select id, published, x.a || '/' || x.b as number from r where x.a <> ''),
    o as (select id, published, unnest(list_transform(regexp_extract_all(title, 'č\.?\s*\d+[a-z]?\s*/\s*\d{4}'), lambda x: regexp_replace(regexp_replace(x, '^č\.?', ''), '\s', '', 'g'))) as number from d),
    g as (select distinct o.id from o join b using (number) left join b as own on own.id = o.id where b.id <> o.id and (own.number is null or own.number <> o.number or (b.published, b.id) > (o.published, o.id)))
    select id, cur and id not in (select id from g) as is_current from d""",
)
def title_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    says = F.when(d % 7 == 0, F.concat(F.lit(" (původně stanovisko č."), (d % 45).cast("string"), F.lit(" / 2011)"))).otherwise("")
    title = F.concat(F.lit("Stanovisko CHJ č. "), (d % 50).cast("string"), F.lit("/"), (2010 + d % 3).cast("string"), says)
    docs = table(spark, sf_dir, "documents").select(d.alias("id"), title.alias("title"), F.date_add(F.lit("2020-01-01").cast("date"), (d % 90).cast("int")).alias("published"), (d % 11 != 0).alias("is_current"))
    return changes.superseded_by_title(docs).select("id", "is_current")


_ACTS = """a as (select o_orderkey as seq, case when o_orderkey % 9 = 0 then 'JINY' else 'PRAVPRED' end as kind, case when o_orderkey % 5 <> 0 then (o_custkey % 300)::varchar || '/2000 Sb.' end as citation,
      case when o_orderkey % 10 <> 0 then (o_custkey % 300)::varchar || '/2001 Sb.' end as other_citation, case when o_orderkey % 8 = 0 then 'x' end as repealed, case when o_orderkey % 3 = 0 then o_orderdate::date end as ends,
      case o_orderkey % 6 when 0 then 'ZAKON' when 1 then 'VYHLASKA' when 2 then 'DEKRETUST' when 3 then 'NECO' when 4 then 'ZAKONUST' end as subtype, case when o_orderkey % 4 = 0 then o_orderpriority end as title, case when o_orderkey % 7 = 0 then o_orderstatus end as declared from orders)"""


def _acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    number = (c % 300).cast("string")
    subtype = F.when(k % 6 == 0, "ZAKON").when(k % 6 == 1, "VYHLASKA").when(k % 6 == 2, "DEKRETUST").when(k % 6 == 3, "NECO").when(k % 6 == 4, "ZAKONUST")
    return table(spark, sf_dir, "orders").select(
        k.alias("seq"), F.when(k % 9 == 0, "JINY").otherwise("PRAVPRED").alias("kind"), F.when(k % 5 != 0, F.concat(number, F.lit("/2000 Sb."))).alias("citation"),
        F.when(k % 10 != 0, F.concat(number, F.lit("/2001 Sb."))).alias("other_citation"), F.when(k % 8 == 0, "x").alias("repealed"), F.when(k % 3 == 0, F.to_date("o_orderdate")).alias("ends"),
        subtype.alias("subtype"), F.when(k % 4 == 0, F.col("o_orderpriority")).alias("title"), F.when(k % 7 == 0, F.col("o_orderstatus")).alias("declared"),
    )


@query(
    "valid_acts",
    f"""with {_ACTS}, v as (select *, coalesce(citation, other_citation) as c from a where kind = 'PRAVPRED' and repealed is null and (ends is null or ends > date '1996-06-01'))
    select c as citation, {_cases(mappings.DOC_TYPES, "arg_max(coalesce(subtype, '-'), seq)", mappings.OTHER_TYPE)} as doc_type, arg_max(coalesce(title, declared, c), seq) as title from v where c is not null group by c""",
)
def valid_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.valid_acts(_acts(spark, sf_dir), "1996-06-01")


_HISTORY = f"""{_ACTS}, s as (select citation, arg_max(coalesce(subtype, '-'), seq) as subtype from a where citation is not null group by 1),
    h as (select a.citation, 'iri/' || seq::varchar as version, ends, {_cases(mappings.DOC_TYPES, "s.subtype", None)} as doc_type from a join s using (citation) where ends >= date '1996-01-01')"""


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = _acts(spark, sf_dir)
    subtypes = changes.first_versions(acts.filter("citation is not null"), "citation", "seq", ["subtype"], last=True)
    found = acts.select("citation", F.concat(F.lit("iri/"), F.col("seq").cast("string")).alias("version"), "ends")
    return changes.historical_versions(found, subtypes, "1996-01-01")


@query("historical_versions", f"with {_HISTORY} select citation, version, cast(ends as varchar) as ends, doc_type from h where doc_type is not null")
def historical_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).withColumn("ends", F.col("ends").cast("string")).select("citation", "version", "ends", "doc_type")


@query("history_import", f"with {_HISTORY} select citation, version, false as is_current, true as skip_embedding from h where doc_type is not null and version not in (select 'iri/' || (o_orderkey * 6)::varchar from orders) order by ends, version limit 500")
def history_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").select(F.concat(F.lit("iri/"), (F.col("o_orderkey") * 6).cast("string")).alias("version"))
    return changes.history_import(_history(spark, sf_dir), done, "ends", "version").select("citation", "version", "is_current", "skip_embedding")


@query("chunkless_history", "select o_orderkey as id from orders where o_orderstatus = 'F' and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'A')")
def chunkless_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") != "F").alias("is_current"))
    chunks = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("document_id"))
    return changes.chunkless_history(docs, chunks).select("id")


@query("era_filter", "with d as (select doc_id, doc_id % 3 = 0 as is_new, case when doc_id % 7 <> 0 then (1940 + doc_id % 15)::int end as year from documents) select doc_id from d where not (is_new and coalesce(year between 1945 and 1950, false))")
def era_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", (d % 3 == 0).alias("is_new"), F.when(d % 7 != 0, 1940 + d % 15).alias("year"))
    return rows.filter(changes.outside_era(F.col("is_new"), F.col("year"))).select("doc_id")


@query("title_regex", "select doc_id from documents where regexp_matches(coalesce(text, ''), '(^|\\s)[a-z]{3,5}\\s+([0-9]+|the)\\b', 'i')")
def title_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive patterns over whole texts."""
    return table(spark, sf_dir, "documents").filter(F.rlike(F.coalesce("text", F.lit("")), F.lit(r"(?iu)(^|\s)[a-z]{3,5}\s+([0-9]+|the)\b"))).select("doc_id")


@query(
    "code_mappings",
    f"""with o as (select o_orderkey, case o_orderkey % 5 when 0 then 'ZAKON' when 1 then 'DEKRET' when 2 then 'X' when 3 then 'OPATRSEN' end as sub, case o_orderkey % 4 when 0 then 'pokyny_d' when 1 then 'pokyny_mf' when 2 then 'mi' end as series,
      case o_orderkey % 4 when 0 then 'soudni_prezkum' when 1 then 'mf_chj' when 2 then 'predpis_eu' else 'jine' end as src, case when o_orderkey % 3 <> 0 then 'https://x/esel-esb:eli/cz/sb/' || o_orderkey::varchar end as iri, case o_orderkey % 4 when 0 then 'I. ÚS 5/10' when 1 then 'ii. u s 7' when 2 then '29 Af 4/2012' else 'Pl. US 1' end as num from orders)
    select o_orderkey, {_cases(mappings.DOC_TYPES, "sub", mappings.OTHER_TYPE)} as doc_type, {_cases(*[mappings.ISSUERS["fs"][0], "series", mappings.ISSUERS["fs"][1]])} as fs_issuer, {_cases(*[mappings.ISSUERS["celni"][0], "series", mappings.ISSUERS["celni"][1]])} as celni_issuer,
      case when src = 'soudni_prezkum' then 'soudni_prezkum_uohs' else 'rozhodnuti_uohs' end as decision, {_cases({k: v[0] for k, v in mappings.SOURCES.items()}, "src", None)} as meta_type, {_cases({k: v[1] for k, v in mappings.SOURCES.items()}, "src", None)} as meta_issuer,
      '{mappings.SITE}' || split_part(iri, '{mappings.IRI_MARK}', 2) as url, case when contains(num, 'ÚS') or contains(replace(upper(num), ' ', ''), 'US') then '{mappings.COURTS[0]}' else '{mappings.COURTS[1]}' end as court from o""",
)
def code_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    sub = F.when(k % 5 == 0, "ZAKON").when(k % 5 == 1, "DEKRET").when(k % 5 == 2, "X").when(k % 5 == 3, "OPATRSEN")
    series = F.when(k % 4 == 0, "pokyny_d").when(k % 4 == 1, "pokyny_mf").when(k % 4 == 2, "mi")
    src = F.when(k % 4 == 0, "soudni_prezkum").when(k % 4 == 1, "mf_chj").when(k % 4 == 2, "predpis_eu").otherwise("jine")
    iri = F.when(k % 3 != 0, F.concat(F.lit("https://x/esel-esb:eli/cz/sb/"), k.cast("string")))
    number = F.when(k % 4 == 0, "I. ÚS 5/10").when(k % 4 == 1, "ii. u s 7").when(k % 4 == 2, "29 Af 4/2012").otherwise("Pl. US 1")
    meta = mappings.source_meta(src)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", mappings.doc_type(sub).alias("doc_type"), mappings.issuer(series, "fs").alias("fs_issuer"), mappings.issuer(series, "celni").alias("celni_issuer"), mappings.decision_type(src).alias("decision"),
        meta["doc_type"].alias("meta_type"), meta["issuer"].alias("meta_issuer"), mappings.act_url(iri).alias("url"), mappings.court(number).alias("court"),
    )


@query(
    "copied_versions",
    """with n as (select o_orderkey as id, o_orderdate as at from orders), o as (select o_orderkey as id, 'v' || o_custkey::varchar as v, o_orderdate + to_days((o_orderkey % 3 - 1)::int) as at from orders where o_orderkey % 4 <> 0)
    select n.id, case when o.id is null then 'missing' when o.at <= n.at then 'set' else 'stale' end as status, case when o.at <= n.at then o.v end as version from n left join o using (id)""",
)
def copied_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, orders = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    new = orders.select(k.alias("id"), F.lit(None).cast("string").alias("version"), F.col("o_orderdate").cast("timestamp").alias("at"))
    old = orders.filter("o_orderkey % 4 <> 0").select(k.alias("id"), F.concat(F.lit("v"), F.col("o_custkey").cast("string")).alias("version"), (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval((k % 3 - 1).cast("int"))).alias("at"))
    return changes.copied_version(new, old, "id", "version", "at")


@query(
    "colocated_reports",
    "select r.o_orderkey as id, l.shard, l.id is null as skipped from orders r left join (select c_custkey as id, case when c_nationkey < 8 then 'a' else 'b' end as shard from customer where c_custkey % 3 <> 0) l on l.id = r.o_custkey",
)
def colocated_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    laws = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("law"), F.when(F.col("c_nationkey") < 8, "a").otherwise("b").alias("shard"))
    reports = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("explains"))
    return changes.colocated(reports, laws, "explains", "law").select("id", "shard", "skipped")


@query(
    "wanted_texts",
    "with f as (select l_orderkey as k, arg_min(case when l_linenumber % 3 = 0 then '  ' else l_linestatus || l_quantity::int::varchar end, l_shipdate::varchar || l_linenumber::varchar) as text from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F') group by 1) select k, text from f where trim(text) <> ''",
)
def wanted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    text = F.when(F.col("l_linenumber") % 3 == 0, "  ").otherwise(F.concat("l_linestatus", F.col("l_quantity").cast("int").cast("string")))
    at = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"), F.col("l_linenumber").cast("string"))
    place = F.when(at.isNotNull(), F.struct(at, "_metadata.file_path", "_metadata.row_index"))  # of texts at the same time, the one that stands first in the files
    return changes.wanted_texts(needed, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), place.alias("at"), text.alias("text")), "k", "at")


@query("first_version", "select o_custkey, arg_min(o_orderpriority, o_orderkey) as first_priority, min(o_orderkey) as first_key, arg_max(o_orderpriority, o_orderkey) as last_priority from orders group by 1")
def first_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    first = changes.first_versions(rows, "o_custkey", "o_orderkey", ["o_orderpriority", "o_orderkey"]).toDF("o_custkey", "first_priority", "first_key")
    last = changes.first_versions(rows, "o_custkey", "o_orderkey", ["o_orderpriority"], last=True).toDF("o_custkey", "last_priority")
    return first.join(last, "o_custkey")


@query("column_intersection", "select c_custkey as key, c_name as name from customer union all select s_suppkey, s_name from supplier")
def column_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").selectExpr("c_custkey as key", "c_name as name", "c_mktsegment as segment")
    right = table(spark, sf_dir, "supplier").selectExpr("s_acctbal as balance", "s_name as name", "s_suppkey as key")
    both = changes.shared_columns(left, right)
    return left.select(*both).unionByName(right.select(*both))


_MOVE = """s as (select l_orderkey as id, l_linenumber as no from lineitem where l_orderkey % 2 = 0), t as (select l_orderkey as id, l_linenumber as no from lineitem where l_orderkey % 2 = 1 or (l_orderkey % 14 = 0 and l_linenumber = 1)),
    w as (select distinct id from s where id % 3 = 0), c as (select s.* from s join w using (id)), a as (select * from t union all select * from c),
    r as (select id, n_source, n_target, n_source = n_target as verified from (select id, count(*) as n_source from c group by 1) join (select id, count(*) as n_target from a group by 1) using (id))"""


def _move(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("no"))
    source, target = lines.filter("id % 2 = 0"), lines.filter("id % 2 = 1 or (id % 14 = 0 and no = 1)")
    return changes.moved(source, target, source.filter("id % 3 = 0").select("id"), "id")


@query("move_report", f"with {_MOVE} select * from r")
def move_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _move(spark, sf_dir)[2]


@query("move_result", f"with {_MOVE} select 'source' as side, id, count(*) as n from s where id not in (select id from r where verified) group by all union all select 'target', id, count(*) from a group by all")
def move_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target, _ = _move(spark, sf_dir)
    both = source.select(F.lit("source").alias("side"), "id").unionByName(target.select(F.lit("target").alias("side"), "id"))
    return both.groupBy("side", "id").agg(F.count("*").alias("n"))


@query(
    "shard_report",
    """with d as (select distinct case when o_orderkey % 7 = 0 then 'x' when o_orderkey % 3 = 0 then 'a' else 'b' end as shard, o_orderkey % 5000 as id from orders),
    c as (select case when l_orderkey % 7 = 0 then 'x' when l_orderkey % 3 = 0 then 'a' else 'b' end as shard, l_orderkey % 5000 as id, count(*) as n, count(*) filter (where l_returnflag = 'N') as open from lineitem where l_linenumber <= 5 group by all),
    r as (select d.shard, d.id, coalesce(n, 0) as n, coalesce(open, 0) as open from d left join c using (shard, id)), b as (select * from r union all select 'all', id, sum(n), sum(open) from r group by id)
    select shard, count(*) as documents, count(*) filter (where n > 0 and open = 0) as complete, sum(n)::bigint as chunks, sum(open)::bigint as pending, round(case when sum(n) = 0 then 100.0 else 100.0 * (sum(n) - sum(open)) / sum(n) end, 6) as percent from b group by shard""",
)
def shard_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    shard = lambda k: F.when(F.col(k) % 7 == 0, "x").when(F.col(k) % 3 == 0, "a").otherwise("b").alias("shard")
    docs = table(spark, sf_dir, "orders").select(shard("o_orderkey"), (F.col("o_orderkey") % 5000).alias("id"))
    chunks = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 5").select(shard("l_orderkey"), (F.col("l_orderkey") % 5000).alias("document_id"), (F.col("l_returnflag") == "N").alias("pending"))
    return changes.shard_report(docs, chunks).withColumn("percent", F.round("percent", 6))


@query("size_guard", "select l_suppkey, sum(l_quantity)::bigint * 33000 as bytes from lineitem group by 1 having sum(l_quantity)::bigint * 33000 >= 480 * 1048576")
def size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((F.sum("l_quantity").cast("bigint") * 33_000).alias("bytes"))
    return upkeep.over_guard(sizes)


@query("fifo_by_type", "select event_id from events where event_type = 'error' order by ts, event_id limit 100")
def fifo_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("event_type = 'error'").orderBy("ts", "event_id").limit(100).select("event_id")


@query(
    "migration_order",
    """select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R') order by (case when o_orderpriority = '1-URGENT' then 0 else 1 end), coalesce(case when o_orderkey % 3 = 0 then o_orderdate::date end, case when o_orderkey % 5 <> 0 then o_orderdate::date + 9 end, date '1900-01-01'),
      case when o_orderkey % 5 <> 0 then o_orderdate::date + 9 end nulls last, o_orderkey limit 300""",
)
def migration_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What isn't migrated yet, by one anti join and a top list, however long the prefix that is done."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderpriority") == "1-URGENT").alias("first"), F.when(k % 3 == 0, day).alias("valid_from"), F.when(k % 5 != 0, F.date_add(day, 9)).alias("valid_until"))
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return rows.join(done, "o_orderkey", "left_anti").orderBy(*upkeep.migration_order(F.col("first")), "o_orderkey").limit(300).select("o_orderkey")


@query("foreign_order", "select l_orderkey, l_linenumber from lineitem left join (select * from orders where o_orderkey % 4 <> 0) on o_orderkey = l_orderkey where l_returnflag = 'N' order by o_orderdate desc nulls last, l_shipdate desc, l_orderkey, l_linenumber limit 200")
def foreign_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").filter("o_orderkey % 4 <> 0").select("o_orderkey", "o_orderdate")
    rows = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'N'").join(docs, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.orderBy(F.desc_nulls_last("o_orderdate"), F.desc("l_shipdate"), "l_orderkey", "l_linenumber").limit(200).select("l_orderkey", "l_linenumber")


@query("batches_of", "select l_suppkey, (n - 1) // 25 as batch, count(*) as n from (select l_suppkey, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) as n from lineitem) group by all")
def batches_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes.batched(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"), 25, "l_suppkey", "l_orderkey", "l_linenumber")
    return rows.groupBy("l_suppkey", "batch").agg(F.count("*").alias("n"))


@query(
    "queue_first_phase",
    "select o_orderkey from orders order by (case when o_orderpriority = '1-URGENT' and o_orderstatus = 'O' then 0 else 1 end), o_orderpriority, o_orderdate, o_orderkey limit 500",
)
def queue_first_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    phase = changes.first_phase(table(spark, sf_dir, "orders"), F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "O")
    return table(spark, sf_dir, "orders").orderBy(phase, "o_orderpriority", "o_orderdate", "o_orderkey").limit(500).select("o_orderkey")


@query(
    "queue_exhaustion",
    """with b as (select user_id as shard, event_id as no, case when event_type in ('click', 'error') then 5 else 0 end as size from events), i as (select *, sum((size > 0)::int) over (partition by shard order by no) as g from b),
    r as (select *, sum((size = 0)::int) over (partition by shard, g order by no) as run from i), s as (select *, min(case when size = 0 and run >= 3 then no end) over (partition by shard) as stop from r)
    select shard, count(*) as asked, sum(size)::bigint as served from s where stop is null or no <= stop group by 1""",
)
def queue_exhaustion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("shard"), F.col("event_id").alias("no"), F.when(F.col("event_type").isin("click", "error"), 5).otherwise(0).alias("size"))
    return changes.served_rounds(rows, "shard", "no", "size").groupBy("shard").agg(F.count("*").alias("asked"), F.sum("size").cast("bigint").alias("served"))


@query(
    "embed_budget",
    """with f as (select user_id as id, count(*) as n from events where event_type = 'error' group by 1 having count(*) >= 3), p as (select c_custkey, row_number() over (order by c_acctbal desc, c_custkey) as place from customer where c_custkey not in (select id from f))
    select c_custkey as id from p where place <= 200 and place <= 5000 - (select count(*) from events where ts::date = date '2024-01-02')""",
)
def embed_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("at"), (F.col("event_type") != "error").alias("ok"))
    queue = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    return changes.embed_today(queue, log, "2024-01-02", 5000, 200, F.desc("c_acctbal"), "id").select("id")


@query(
    "archive_keys",
    """with r as (select o_custkey::varchar as key, case when o_orderkey % 3 <> 0 then 'iri/2020/' || md5(o_orderkey::varchar) || '/znění' end as v, o_orderkey, o_orderstatus from orders)
    select o_orderkey, key || '#hist-' || coalesce(right(v, 40), sha1(concat_ws('|', key, o_orderkey, o_orderstatus))) as archive_key from r""",
)
def archive_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, key = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    version = F.when(k % 3 != 0, F.concat(F.lit("iri/2020/"), F.md5(k.cast("string")), F.lit("/znění")))
    return table(spark, sf_dir, "orders").select("o_orderkey", mappings.archive_key(key, version, key, k, F.col("o_orderstatus")).alias("archive_key"))
