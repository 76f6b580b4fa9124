"""The corpus pipeline: five stages, each of which reads what its predecessor wrote.

toxicity: documents scored 0.5 or more go. exact_dedup: of equal texts the smallest doc_id stays. near_dedup: of documents
linked at a similarity of 0.8 on five-word shingles the smallest doc_id stays. decontamination: documents that hold
benchmark passages go. mixing: the rest is mixed to source weights; the last stage returns the documents that the mix
takes, with their copies and the words taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import common, decontam, dedup, mixing, neardup, toxicity
from inkwell.session import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a score below 0.5; the classifier learns from the labelled ones of these documents.

    Null and empty texts have the score of no features; texts are read whole; rows are judged one by one, repeated rows
    alike; without labels nothing goes; an empty table stays empty; other columns pass through, whatever they are called.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(toxicity.sample(labels, docs, held_out=toxicity.held_out()))
    score = common.clash_free(docs.columns, "toxicity_score")
    return toxicity.scored(docs, model, score=score).filter(F.col(score) < 0.5).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that with the smallest doc_id; one of those that tie.

    Null texts are empty texts and equal to each other; null keys come last; texts are compared whole; an empty table stays
    empty; other columns pass through, whatever they are called.
    """
    return dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: that with the smallest doc_id.

    Texts without words, null ones and rows without a key are near nothing and stay; rows of one key are one document; texts
    are read whole; an empty table stays empty; other columns pass through, whatever they are called.
    """
    return neardup.deduplicated(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words are words of benchmark passages.

    Null texts have no words and stay; texts are searched whole; rows are judged one by one, repeated rows alike; without
    benchmark items nothing goes; an empty table stays empty; other columns pass through, whatever they are called.
    """
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least one copy in the mix: their columns, size, source_size, target, copies and taken.

    Texts without words, null ones too, aren't taken; null sources are a source; rows that tie in key and size are taken alike;
    an empty table stays empty; columns called like the five stay as they are and the five's are left out.
    """
    return mixing.taken_rows(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: A trained classifier, a randomised join and an iterative solver are no SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the table documents; each stage reads what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, common.written(stage(spark, docs, sf_dir), f"stage-{name}")
        common.dropped(before)
    return docs
