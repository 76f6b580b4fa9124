"""The registered queries of the training-data operators, one for each, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.session import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.license import scanned

    found = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.array_max(F.transform("licences", lambda x: F.struct(x["probability"].alias("p"), x["family"].alias("family"))))
    return found.select(
        "doc_id", "n_paragraphs", "candidates", F.size("licences").cast("bigint").alias("n_licences"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"]))), ",").alias("families"),
        F.coalesce(best["family"], F.lit("unknown")).alias("family"), F.round(best["p"], 6).alias("probability"),
        F.array_join(F.transform("licences", lambda x: x["line"].cast("string")), ",").alias("lines"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm import decontam

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.matched(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        F.col("row.c0").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontam.contaminated().alias("contaminated"),
        F.coalesce(F.array_max(F.transform("spans", lambda x: x["n_words"])), F.lit(0)).cast("bigint").alias("longest_match"),
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm import chat, common

    said = "\\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    output = common.written(chat.formatted(turns.unionByName(more)), "chat")
    return chat.digests(output)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm import common, warc

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = common.new_folder(spark, "warc")
    manifest = warc.write_archives(warc.with_revisits(pages), folder)
    read = warc.records(warc.read_archives(spark, manifest, data=False))
    found = common.written(read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "warc-records")
    common.delete(spark, folder)
    return found


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.mixing import mixed

    return mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, percent=80)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm import common, lm

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = lm.train(docs.filter(~lm.held_out()))
    found = lm.scored(docs, model).select("doc_id", lm.held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("bigint").alias("train_tokens"), "base_score", "score")
    found = common.written(found, "lm-scores")
    lm.released(spark, model)
    return found


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.dedup import decisions

    return decisions(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP8_SQL = """
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as body from documents)
select doc_id, min(doc_id) over (partition by body) as keep_id, count(*) over (partition by body) as group_size,
       doc_id = min(doc_id) over (partition by body) as kept, sha256(body) as text_sha256
from n
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(toxicity.sample(labels, docs, held_out=toxicity.held_out()))
    scored = toxicity.scored(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from inkwell.llm.tokens import token_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts(
        docs,
        public_tokenizers.path("byte_bpe_50k.json"),
        ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"),
        pattern=public_tokenizers.PATTERN,
        special=("<|endoftext|>",),
    )
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.audit import audit

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = audit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


OP11_SQL = """
with w as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words
  from documents),
f as (
  select w.part, coalesce(l.quality = 1, false) as good, coalesce(l.toxic = 1, false) as toxic,
         (case when len(words) < 50 then 'A' else '' end) || (case when 100 * len(list_distinct(words)) < 65 * len(words) then 'B' else '' end)
         || (case when 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) then 'C' else '' end)
         || (case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end)
         || (case when w.doc_id > min(w.doc_id) over (partition by t) then 'E' else '' end) as fails
  from w left join labels l on w.doc_id = l.doc_id),
p as (select part, fails, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from f group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as l),
o as (select a.l || b.l || c.l || d.l || e.l as filter_order from x a, x b, x c, x d, x e
      where b.l <> a.l and c.l not in (a.l, b.l) and d.l not in (a.l, b.l, c.l) and e.l not in (a.l, b.l, c.l, d.l)),
s as (select filter_order, step::int as step, substr(filter_order, step, 1) as filter, substr(filter_order, 1, step - 1) as before from o, range(1, 6) r(step)),
c as (
  select part, filter_order, step, filter,
         sum(n) filter (where translate(fails, before, '') = fails and not contains(fails, filter)) as kept,
         sum(n) filter (where translate(fails, before, '') = fails and contains(fails, filter)) as removed,
         sum(n) filter (where translate(fails, before, '') <> fails and contains(fails, filter)) as redundant,
         sum(n) filter (where fails = filter) as unique_fails,
         sum(good) filter (where translate(fails, before, '') = fails and contains(fails, filter)) as good_lost,
         sum(toxic) filter (where translate(fails, before, '') = fails and contains(fails, filter)) as toxic_lost
  from p, s group by all)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
       coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
       sum(coalesce(removed, 0)) over (partition by part, filter)::bigint as shapley
from c
"""


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm import fingerprint as fp

    found = fp.edited_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("key").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fp.written_out(F.col("sketch")).alias("fingerprint"), fp.written_out(F.col("edited_sketch")).alias("edited_fingerprint"),
        fp.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), fp.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkwell.llm.centroids import clustered

    return clustered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _op13_sql() -> str:
    from inkwell.llm.centroids import sql

    return sql()


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "pipeline": pipeline,
    "op1_license_scan": op1_license_scan,
    "op2_decontamination": op2_decontamination,
    "op3_chat_format": op3_chat_format,
    "op4_warc": op4_warc,
    "op5_mixing": op5_mixing,
    "op6_near_dedup": op6_near_dedup,
    "op7_lm_score": op7_lm_score,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
    "op11_filter_audit": op11_filter_audit,
    "op12_fingerprints": op12_fingerprints,
    "op13_centroid_clusters": op13_centroid_clusters,
}
SQL: dict[str, str] = {"op8_exact_dedup": OP8_SQL, "op11_filter_audit": OP11_SQL}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return SQL | {"op13_centroid_clusters": _op13_sql()}
