"""Retrieval queries: vectors, as-of validity, fusion, keywords, stages, hydration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text, vector
from inkwell.operators import retrieval, versions
from inkwell.plans import text_queries
from inkwell.plans.registry import query
from inkwell.session import table

#: The similarity of each embedding to that of vec_id 0, as DuckDB computes it.
SIMILARITY = "s as (select e.vec_id, e.label, list_cosine_similarity(e.embedding::double[], q.v) as sim from embeddings e, (select embedding::double[] as v from embeddings where vec_id = 0) q where e.embedding is not null)"


def asked_vector(vectors: DataFrame) -> list[float]:
    """The query vector: one row, by its key."""
    return [float(x) for x in vectors.filter("vec_id = 0").select("embedding").first()[0]]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.scored(vectors, asked_vector(vectors), out="sim")


@query(
    "vector_topk",
    f"with {SIMILARITY} select s.vec_id, s.label, d.source, round(s.sim, 6) as similarity from s join documents d on d.doc_id = s.vec_id where s.sim >= 0.1 order by s.sim desc, s.vec_id limit 10",
)
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    rows = _scored(spark, sf_dir).join(documents, F.col("doc_id") == F.col("vec_id"))
    return retrieval.top_k(rows, 10, "vec_id", score="sim", floor=0.1).select("vec_id", "label", "source", F.round("sim", 6).alias("similarity"))


_VERSIONS = "v as (select o_custkey, o_orderkey, o_orderdate::date as valid_from, lead(o_orderdate::date) over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as valid_until from orders)"


def _order_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    following = F.lead(F.to_date("o_orderdate")).over(order)
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("valid_from"), F.date_sub(following, 1).alias("valid_until"), following.isNull().alias("is_current"))


@query(
    "asof_versions",
    f"with {_VERSIONS} select o_custkey, count(*) as n, max(o_orderkey) as newest from v where (valid_from is null or valid_from <= date '1996-06-30') and (valid_until is null or date '1996-06-30' <= valid_until) group by o_custkey",
)
def asof_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_versions(spark, sf_dir).filter(retrieval.valid_at("1996-06-30")).groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("newest"))


@query("current_versions", f"with {_VERSIONS} select o_custkey, o_orderkey, cast(valid_from as varchar) as valid_from from v where valid_until is null")
def current_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_versions(spark, sf_dir).filter(retrieval.valid_at(None)).select("o_custkey", "o_orderkey", F.col("valid_from").cast("string"))


@query(
    "vector_topk_asof",
    f"""with {SIMILARITY}, {_VERSIONS} select s.vec_id, v.o_orderkey, round(s.sim, 6) as similarity from s join v on v.o_custkey = s.vec_id
    where (v.valid_from is null or v.valid_from <= date '1997-01-31') and (v.valid_until is null or date '1997-01-31' <= v.valid_until) and s.label in (1, 2, 3, 5)
    order by s.sim desc, s.vec_id, v.o_orderkey limit 8""",
)
def vector_topk_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = _order_versions(spark, sf_dir).filter(retrieval.valid_at("1997-01-31"))
    rows = _scored(spark, sf_dir).filter(retrieval.member("label", [1, 2, 3, 5])).join(valid, F.col("o_custkey") == F.col("vec_id"))
    return retrieval.top_k(rows, 8, "vec_id", "o_orderkey", score="sim").select("vec_id", "o_orderkey", F.round("sim", 6).alias("similarity"))


@query(
    "per_source_topk",
    f"with {SIMILARITY}, r as (select *, row_number() over (partition by label order by sim desc, vec_id) as rank_in_source from s) select label, vec_id, rank_in_source, round(sim, 6) as similarity from r where rank_in_source <= 5",
)
def per_source_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.top_k_by(_scored(spark, sf_dir), "label", 5, "vec_id", score="sim")
    return rows.select("label", "vec_id", F.col("rank_in_source").cast("bigint"), F.round("sim", 6).alias("similarity"))


@query(
    "per_source_topk_fused",
    f"""with {SIMILARITY}, w as (select s.*, d.source as title, case when s.label in (2, 4, 6) then sim * 0.55 else sim end as score, d.lang as heading from s join documents d on d.doc_id = s.vec_id),
    r as (select *, row_number() over (partition by label order by score desc, vec_id) as rn from w), t as (select *, row_number() over (order by score desc, label, rn, vec_id) as position from r where rn <= 5),
    f as (select *, row_number() over (partition by title, coalesce(heading, '') order by position) as occ from t where position <= 20)
    select vec_id, label, title, row_number() over (order by position) as citation, round(score, 6) as similarity, floor(score * 100 + 0.5)::bigint as relevance from f where occ = 1""",
)
def per_source_topk_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("heading"))
    rows = _scored(spark, sf_dir).join(documents, F.col("doc_id") == F.col("vec_id"))
    rows = rows.withColumn("similarity", F.when(F.col("label").isin(2, 4, 6), F.col("sim") * retrieval.DOWN_WEIGHT).otherwise(F.col("sim")))
    best = retrieval.top_k_by(rows, "label", 5, "vec_id")
    out = retrieval.fused(best, source_rank="label", tie="vec_id")
    return out.select("vec_id", "label", "title", F.col("citation").cast("bigint"), F.round("similarity", 6).alias("similarity"), retrieval.relevance_percent("similarity").alias("relevance"))


@query(
    "clarify_flags",
    f"with {SIMILARITY}, t as (select * from s order by sim desc, vec_id limit 6) select bool_or(label not in (2, 4, 6)) and bool_or(label in (2, 4, 6) and sim > 0.2) as clarify from t",
)
def clarify_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("doc_type"), F.col("sim").alias("similarity"))
    return retrieval.needs_clarification(rows, "jaké jsou lhůty", special=["2", "4", "6"], over=0.2)


@query(
    "l2_normalise_norms",
    """with n as (select vec_id, embedding::double[] as v, sqrt(list_inner_product(embedding::double[], embedding::double[])) as norm from embeddings)
    select vec_id, round(norm, 6) as norm, round(list_sum(list_transform(v, lambda x: x / norm)), 6) as total, round(sqrt(list_inner_product(v[1:16], v[1:16])), 6) as head_norm from n""",
)
def l2_normalise_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.aggregate(vector.l2_normalised("embedding"), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.norm("embedding"), 6).alias("norm"), F.round(unit, 6).alias("total"), F.round(vector.norm(F.slice("embedding", 1, 16)), 6).alias("head_norm"))


@query(
    "vector_pairs_by_label",
    """with v as (select label, vec_id, embedding::double[] as e, row_number() over (partition by label order by vec_id) as rn from embeddings)
    select a.label, a.vec_id as first_id, b.vec_id as other_id, round(list_cosine_similarity(a.e, b.e), 6) as similarity from v a join v b on a.label = b.label and a.rn = 1 and b.rn > 1""",
)
def vector_pairs_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    firsts = vectors.groupBy("label").agg(F.min("vec_id").alias("first_id"), F.min_by("embedding", "vec_id").alias("first"))
    rows = vectors.join(F.broadcast(firsts), "label").filter("vec_id <> first_id")  # one row for each label
    return rows.select("label", "first_id", F.col("vec_id").alias("other_id"), F.round(vector.cosine("first", "embedding"), 6).alias("similarity"))


@query(
    "keyword_any",
    rf"select doc_id, lang from documents where list_has_any(regexp_split_to_array(lower(text), '{text.WORD_BREAKS}'), ['thst', 'que', 'schder', 'eau']) order by doc_id limit 12",
)
def keyword_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return retrieval.keyword_hits(docs, "text", ["thst", "que", "schder", "eau"], "doc_id").select("doc_id", "lang")


@query(
    "staged_search",
    rf"""with w as (select doc_id, regexp_split_to_array(lower(text), '{text.WORD_BREAKS}') as ws from documents),
    s as (select doc_id, case when doc_id = 17 then 0 when list_has_all(ws, ['than', 'erth']) then 1 when list_has_any(ws, ['than', 'erth']) then 2 end as stage from w)
    select doc_id, stage::int as stage, ['cislo', 'fulltext', 'fulltext_volne'][stage + 1] as match from s where stage is not null order by stage, doc_id limit 20 offset 2""",
)
def staged_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, other = text.has_word("text", "than"), text.has_word("text", "erth")
    stages = (("cislo", F.col("doc_id") == 17), ("fulltext", one & other), ("fulltext_volne", one | other))
    return retrieval.staged_match(table(spark, sf_dir, "documents"), stages, "doc_id", k=20, offset=2).select("doc_id", "stage", "match")


@query(
    "hydrated_content",
    "select doc_id, case when doc_id % 3 = 0 then sha256(text) else text end as content from documents",
)
def hydrated_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    moved = F.col("doc_id") % 3 == 0
    chunks = docs.select(F.col("doc_id").alias("id"), F.when(moved, F.lit("")).otherwise(F.col("text")).alias("content"))
    stored = docs.filter(moved).select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content"))
    return retrieval.hydrated(chunks, stored).select(F.col("id").alias("doc_id"), "content")


@query("hydrated_content_whole", "select doc_id, text as content from documents")
def hydrated_content_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hydrated_content over whole texts, of which a third is in the store."""
    docs = table(spark, sf_dir, "documents")
    moved = F.col("doc_id") % 3 == 0
    chunks = docs.select(F.col("doc_id").alias("id"), F.when(moved, F.lit("")).otherwise(F.col("text")).alias("content"))
    stored = docs.filter(moved).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return retrieval.hydrated(chunks, stored).select(F.col("id").alias("doc_id"), "content")


@query(
    "last_turns",
    "with r as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn desc) as rn from conversations where trim(coalesce(text, '')) <> '') select conv_id, turn, role from r where rn <= 4",
)
def last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    said = table(spark, sf_dir, "conversations").filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return said.withColumn("rn", rank).filter("rn <= 4").select("conv_id", "turn", "role")


@query(
    "history_pairs",
    """with t as (select conv_id, turn, role, left(text, 4000) as text, lead(role) over w as nrole, left(lead(text) over w, 8000) as ntext from conversations window w as (partition by conv_id order by turn))
    select conv_id, turn, length(text) as question_chars, length(ntext) as answer_chars from t where role = 'user' and nrole = 'assistant'""",
)
def history_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("*", F.lead("role").over(order).alias("next_role"), F.lead("text").over(order).alias("next_text")).filter("role = 'user' and next_role = 'assistant'")
    return rows.select("conv_id", "turn", F.length(F.substring("text", 1, 4000)).cast("bigint").alias("question_chars"), F.length(F.substring("next_text", 1, 8000)).cast("bigint").alias("answer_chars"))


@query(
    "cited_sources",
    r"""with a as (select doc_id, '[' || (doc_id % 5) || '] a [' || (doc_id % 3) || '][W' || (doc_id % 2) || ']' as answer from documents), s as (select unnest(range(0, 5))::int as n)
    select doc_id, n, list_contains(list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: x::int), n) as cited from a, s""",
)
def cited_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda m: (F.col("doc_id") % m).cast("string")
    answer = F.concat(F.lit("["), number(5), F.lit("] a ["), number(3), F.lit("][W"), number(2), F.lit("]"))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.cited(answer).alias("cited"))
    return docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("n"), "cited").select("doc_id", "n", F.array_contains("cited", F.col("n")).alias("cited"))


_QUESTION, _QUESTION_SQL = text_queries.said("účtování podle IFRS", "lhůty pro odvolání", "sazba DPH a kartel", "nájem bytu č. #", "ochrana osobních údajů, GDPR", None)
_TYPES = (*retrieval.DOMAIN_HINTS, "zakon", "judikat")
#: What a domain's pattern says with look-arounds, in words that DuckDB has.
_HINT_SQL = " ".join(f"when t = '{name}' and not coalesce(regexp_matches(s, '{text_queries.re2_words(pattern)}'), false) then 0.8 * {retrieval.DOWN_WEIGHT}" for name, pattern in retrieval.DOMAIN_HINTS.items())


@query(
    "domain_weights",
    f"""with q as (select doc_id, {_QUESTION_SQL} as s, [{", ".join(f"'{t}'" for t in _TYPES)}][(doc_id // 6) % {len(_TYPES)} + 1] as t from documents)
    select doc_id, t as doc_type, case when s is null and t not in ('zakon', 'judikat') then 0.8::double {_HINT_SQL} else 0.8 end as score from q""",
)
def domain_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of hits by type and by what a question names: sentences before whole texts stand for questions."""
    kind = F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (F.floor(F.col("doc_id") / 6) % len(_TYPES) + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", _QUESTION().alias("s"), kind.alias("doc_type"))
    return rows.select("doc_id", "doc_type", retrieval.weighted(F.lit(0.8), F.col("doc_type"), F.col("s")).alias("score"))


@query(
    "prefix_asof_join",
    """with f as (select doc_id, 'r/' || lang || '/' || source || '/' || doc_id as path from documents), v as (select distinct 'r/' || lang as version from documents union select distinct 'r/' || lang || '/' || source from documents where source <> 'src3'),
    j as (select f.doc_id, f.path, v.version, row_number() over (partition by f.doc_id order by length(v.version) desc) as rn from f join v on f.path = v.version or starts_with(f.path, v.version || '/'))
    select doc_id, version from j where rn = 1""",
)
def prefix_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    rows = docs.select("doc_id", F.concat_ws("/", F.lit("r"), "lang", "source", F.col("doc_id").cast("string")).alias("path"))
    known = docs.select(F.concat_ws("/", F.lit("r"), "lang").alias("version")).union(docs.filter("source <> 'src3'").select(F.concat_ws("/", F.lit("r"), "lang", "source"))).distinct()
    return versions.predecessors(rows, known).select("doc_id", F.col("of").alias("version"))


def _section_sql(part_chars: int) -> str:
    return f"""with n as (select 1 as document_id, 'a/' || source as path, source as heading, row_number() over (order by source) as ord from (select distinct source from documents)),
    f as (select doc_id as ord, 'a/' || source || '/' || doc_id as path, trim(text) as text from documents where trim(text) <> ''),
    j as (select n.document_id, (n.ord - 1)::int as chunk_index, n.heading, f.ord, f.path, f.text, sum(length(f.text) + 1) over (partition by n.ord order by f.ord, f.path rows unbounded preceding) - length(f.text) - 1 as before from n join f on f.path = n.path or starts_with(f.path, n.path || '/'))
    select document_id, chunk_index, heading, floor(before / {part_chars})::bigint as part, string_agg(text, ' ' order by ord, path) as content from j group by all"""


def _sections(spark: SparkSession, sf_dir: str, part_chars: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    nodes = docs.select(F.lit(1).alias("document_id"), F.concat(F.lit("a/"), "source").alias("path"), F.col("source").alias("heading"), F.col("source").alias("ord")).distinct()
    fragments = docs.select(F.concat_ws("/", F.lit("a"), "source", F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").alias("ord"), "text")
    return versions.section_parts(nodes, fragments, part_chars=part_chars)


@query("descendant_text", _section_sql(4000))
def descendant_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts below each section in small parts."""
    return _sections(spark, sf_dir, 4000)


@query("descendant_text_whole", _section_sql(1 << 20))
def descendant_text_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts below each section in parts of bounded size."""
    return _sections(spark, sf_dir, 1 << 20)
