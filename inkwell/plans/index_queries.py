"""Keyword searches through a stored index: the rows of the searches that read every text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text
from inkwell.operators import postings, retrieval
from inkwell.operators.prefix import work_folder
from inkwell.plans import detail_queries, retrieval_queries
from inkwell.plans.registry import oracle_of, query
from inkwell.session import table


def _indexed(spark: SparkSession, docs: DataFrame) -> postings.Index:
    index = postings.Index.created(spark, f"{work_folder(spark)}/words", parts=32, span=4096)
    index.add(docs, new=True)
    return index


@query("indexed_keyword_any", oracle_of(retrieval_queries.keyword_any))
def indexed_keyword_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve documents with any of four words, by the index; then their rows."""
    docs = table(spark, sf_dir, "documents")
    index = _indexed(spark, docs.select("doc_id", "text"))
    first = index.first(["thst", "que", "schder", "eau"], 12)
    rows = docs.select("doc_id", "lang").join(F.broadcast(first), F.col("doc_id") == F.col("id"))  # twelve rows
    return rows.orderBy("doc_id").limit(12).select("doc_id", "lang")


@query("indexed_staged_search", oracle_of(retrieval_queries.staged_search))
def indexed_staged_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number, all words, any word: a page of what the stages find, by the index."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = postings.staged(_indexed(spark, docs), docs.filter("doc_id = 17").select("doc_id"), ["than", "erth"])
    return found.orderBy("stage", "id").offset(2).limit(20).select(F.col("id").alias("doc_id"), "stage", "match")


@query("indexed_filtered_search", oracle_of(detail_queries.filtered_search))
def indexed_filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, all pieces of words, any piece, meaning; by organ and day. The text stages ask the index."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = docs.select("doc_id", "source", F.date_add(F.lit("2020-01-01").cast("date"), (d % 400).cast("int")).alias("day"), F.when(d % 50 == 7, "7/2020").otherwise(F.concat(d.cast("string"), F.lit("/2019"))).alias("number"))
    rows = rows.filter(F.col("source").isin("src0", "src1", "src2", "src3") & F.col("day").between(F.lit("2020-02-01").cast("date"), F.lit("2020-12-31").cast("date")))
    found = postings.staged(_indexed(spark, docs), rows.filter("number = '7/2020'").select("doc_id"), ["the", "with"], whole_words=False)
    vectors = table(spark, sf_dir, "embeddings")
    near = retrieval.scored(vectors, retrieval_queries.asked_vector(vectors)).filter("similarity >= 0.1").select(F.col("vec_id").alias("id"), F.lit(3).alias("stage"), F.lit("semantic").alias("match"))
    best = found.unionByName(near).groupBy("id").agg(F.min(F.struct("stage", "match")).alias("s"))
    page = rows.join(best, F.col("doc_id") == F.col("id")).orderBy("s.stage", F.desc("day"), "doc_id").offset(5).limit(20)
    return page.select("doc_id", "s.match")


@query(
    "indexed_updates",
    rf"""with n as (select doc_id, case when doc_id % 10 = 3 then 'Zcela nové znění, que' when doc_id % 10 = 4 then null else text end as text from documents where doc_id % 10 <> 6),
    w as (select doc_id, regexp_split_to_array(lower(text), '{text.WORD_BREAKS}') as ws from n)
    select doc_id, list_has_all(ws, ['que', 'than']) as every, list_contains(ws, 'znění') as fresh from w where list_has_any(ws, ['que', 'than', 'znění'])""",
)
def indexed_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are indexed, a tenth gets another text, a tenth none, a tenth goes: what then has the words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = _indexed(spark, docs)
    index.add(docs.filter("doc_id % 10 = 3").withColumn("text", F.lit("Zcela nové znění, que")))
    index.add(docs.filter("doc_id % 10 = 4").withColumn("text", F.lit(None).cast("string")))
    index.remove(docs.filter("doc_id % 10 = 6"))
    mark = lambda terms, name, every=False: index.documents(terms, every).withColumn(name, F.lit(True))
    rows = index.documents(["que", "than", "znění"]).join(mark(["que", "than"], "every", True), "id", "left").join(mark(["znění"], "fresh"), "id", "left")
    return rows.select(F.col("id").alias("doc_id"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("every", "fresh")])


@query(
    "indexed_word_counts",
    rf"""with w as (select unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '{text.WORD_BREAKS}'), lambda x: x <> ''))) as term from documents)
    select term, count(*) as n from w where term in ('que', 'than', 'erth', 'thst', 'der', 'a') group by 1""",
)
def indexed_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents words are, from an index that was merged from two segments."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = _indexed(spark, docs.filter("doc_id % 3 <> 0"))
    index.add(docs.filter("doc_id % 3 = 0 or doc_id % 7 = 0"))
    whole = index.merged(f"{work_folder(spark)}/merged")
    return whole.counts(["que", "than", "erth", "thst", "der", "a"])
