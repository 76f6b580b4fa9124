"""Retrieval: exact vector top-k, as-of validity, per-source top-k with fusion, keyword and citation look-up.

Top-k is one pass: the global one plans as TakeOrderedAndProject, the per-source one as a window whose rank filter Spark
pushes below the shuffle (WindowGroupLimit), so only k rows of each task and source move.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import text, vector

FLOOR = 0.55
DOWN_WEIGHT = 0.55
FUSED = 20

# ---- fixed values: types whose hits count less unless the question names their domain, and how it is named ----
DOMAIN_HINTS: dict[str, str] = {
    "rozhodnuti_uohs": r"(?<![\p{L}\p{N}])ÚOHS(?![\p{L}\p{N}])|hospod[aá]řsk[ée] sout[eě][žz]|ve[rř]ejn[ée] zak[aá]zky|kart[ea]l",
    "soudni_prezkum_uohs": r"(?<![\p{L}\p{N}])ÚOHS(?![\p{L}\p{N}])|hospod[aá]řsk[ée] sout[eě][žz]|ve[rř]ejn[ée] zak[aá]zky",
    "metodika_ifrs": r"\bIFRS\b|\bIAS\b|mezin[aá]rodn[ií] ú[cč]etn[ií]",
    "cus_podnikatele": r"(?<![\p{L}\p{N}])[cč][uú]\.?s\.?(?![\p{L}\p{N}])|[cč]esk[eé] ú[cč]etn[ií] standard",
    "predpis_eu": r"\bEU\b|evropsk[aá] unie|na[rř][ií]zen[ií] \(EU\)|sm[eě]rnice",
    "metodika_fs": r"finan[cč]n[ií] spr[aá]v|da[nň]ov|\bDPH\b",
    "metodika_celni": r"celn[ií]|\bcla\b",
    "metodika_mv": r"minist?erstv[ao] vnitra|ve[rř]ejn[aá] spr[aá]va",
    "metodika_eru": r"energetick[yý] regula[cč]n[ií]|(?<![\p{L}\p{N}])ERÚ(?![\p{L}\p{N}])|energetik",
    "metodika_mmr": r"stavebn[ií] z[aá]kon|[uú]zemn[ií] pl[aá]n|minist?erstv[ao] pro m[ií]stn[ií] rozvoj",
    "metodika_uoou": r"osobn[ií] [uú]daj|\bGDPR\b|(?<![\p{L}\p{N}])ÚOOÚ(?![\p{L}\p{N}])",
    "metodika": r"metodik",
}
#: The types that a request may name, and the sources that each opens.
SOURCES_OF: dict[str, tuple[str, ...]] = {
    "judikat": ("ns", "judikaty"),
    "rozhodnuti_uohs": ("uohs",),
    "soudni_prezkum_uohs": ("uohs_soudni_prezkum",),
    "metodika": ("metodiky", "fs", "celni", "mv", "eru", "mmr", "uoou"),
    "cus_podnikatele": ("cus",),
    "predpis_eu": ("predpisy_eu",),
    "ifrs": ("ifrs",),
    "zakon": ("zakony",),
}
# ---- end of fixed values ----


def valid_at(as_of: str | None, current: str = "is_current", start: str = "valid_from", end: str = "valid_until") -> Column:
    """Without a day: current rows. With one: rows whose validity, closed at both ends and open where null, holds it."""
    if as_of is None:
        return F.coalesce(F.col(current), F.lit(False))
    day = F.to_date(F.lit(as_of))
    return (F.col(start).isNull() | (F.col(start) <= day)) & (F.col(end).isNull() | (day <= F.col(end)))


def member(column: str, values: Sequence | None) -> Column:
    """Optional membership: no list, no filter."""
    return F.lit(True) if values is None else F.col(column).isin(*values)


def scored(chunks: DataFrame, asked: Sequence[float], embedding: str = "embedding", out: str = "similarity") -> DataFrame:
    """Rows with an embedding and their cosine to the question."""
    return chunks.filter(F.col(embedding).isNotNull()).withColumn(out, vector.cosine_to(embedding, asked))


def top_k(rows: DataFrame, k: int, *ties: str, score: str = "similarity", floor: float | None = None) -> DataFrame:
    kept = rows if floor is None else rows.filter(F.col(score) >= floor)
    return kept.orderBy(F.desc_nulls_last(score), *ties).limit(k)


def top_k_by(rows: DataFrame, group: str, k: int, *ties: str, score: str = "similarity", floor: float | None = None, rank: str = "rank_in_source") -> DataFrame:
    kept = rows if floor is None else rows.filter(F.col(score) >= floor)
    order = Window.partitionBy(group).orderBy(F.desc_nulls_last(score), *ties)
    return kept.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def names_domain(question: str | Column, doc_type: str | None = None) -> Column:
    """Whether a question names the domain of a specialised type (of any, if none is given)."""
    asked = F.col(question) if isinstance(question, str) else question
    pattern = "|".join(f"(?:{p})" for p in DOMAIN_HINTS.values()) if doc_type is None else DOMAIN_HINTS[doc_type]
    return F.rlike(asked, F.lit("(?iu)" + pattern))


def weighted(score: Column, doc_type: Column, question: Column, factor: float = DOWN_WEIGHT, hints: Mapping[str, str] | None = None) -> Column:
    """Scores of specialised types times `factor`, unless the question names the type's own domain."""
    out = None
    for name, pattern in (hints or DOMAIN_HINTS).items():
        own = F.rlike(question, F.lit("(?iu)" + pattern))
        case = (doc_type == name) & ~own
        out = F.when(case, score * factor) if out is None else out.when(case, score * factor)
    return score if out is None else out.otherwise(score)


def fused(rows: DataFrame, *, k: int = FUSED, source_rank: str = "source_rank", title: str = "title", heading: str = "heading", score: str = "similarity", tie: str = "id") -> DataFrame:
    """One list of all sources: the k best first, then the first of each (title, heading), numbered as citations.

    Ties keep the sources' order. What is dropped as a repetition isn't filled up.
    """
    order = [F.desc_nulls_last(score), F.col(source_rank), F.col("rank_in_source"), F.col(tie)]
    best = rows.orderBy(*order).limit(k)  # k rows from here on
    best = best.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    first = Window.partitionBy(title, F.coalesce(F.col(heading), F.lit(""))).orderBy("position")
    kept = best.withColumn("occurrence", F.row_number().over(first)).filter("occurrence = 1").drop("occurrence")
    return kept.withColumn("citation", F.row_number().over(Window.orderBy("position")))


def keyword_hits(chunks: DataFrame, content: str | Column, words: Sequence[str], *ties: str, k: int = 12, every: bool = False) -> DataFrame:
    """The first k rows, in the order of the ties, whose content has any (every: all) of the words; without words, none (every: all)."""
    test = F.lit(every)
    for number, word in enumerate(words):
        one = text.has_word(content, word)
        test = one if number == 0 else test & one if every else test | one
    return chunks.filter(F.coalesce(test, F.lit(False))).orderBy(*ties).limit(k)


def staged_match(rows: DataFrame, stages: Sequence[tuple[str, Column]], *ties: str | Column, k: int = 20, offset: int = 0) -> DataFrame:
    """Search stages in order of preference, as conditions on the same rows; a row bears the label of the first that holds.

    One pass, and nothing is shuffled but the first rows of each task.
    """
    stage, label = F.lit(None).cast("int"), F.lit(None).cast("string")
    for number, (name, test) in reversed(list(enumerate(stages))):
        stage, label = F.when(test, number).otherwise(stage), F.when(test, name).otherwise(label)
    found = rows.withColumns({"stage": stage, "match": label}).filter("stage is not null")
    return found.orderBy("stage", *ties).offset(offset).limit(k)


def first_sources(rows: DataFrame, key: str, source: str) -> DataFrame:
    """Rows of overlapping sources, each key once: that of the first source that has it."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), source).alias("r")).select(key, "r.*")


def gated(requested: Sequence[str] | None, sources: Mapping[str, Sequence[str]] | None = None) -> list[str]:
    """The sources to ask, in order: all without a request (None), else those that serve a requested type; unknown types open none."""
    known = SOURCES_OF if sources is None else sources
    return [name for kind, names in known.items() if requested is None or kind in requested for name in names]


def needs_clarification(hits: DataFrame, question: str, *, special: Sequence[str], forced: bool = False, doc_types: Sequence[str] | None = None, words: int = 10, top: int = 6, over: float = 0.3) -> DataFrame:
    """One row: whether a short, unrestricted question without a domain word hit both general and specialised sources."""
    best = hits.orderBy(F.desc_nulls_last("similarity"), "id").limit(top)
    is_special = F.col("doc_type").isin(*special)
    open_ = F.lit(not forced and not doc_types and len(question.split()) <= words)
    both = F.coalesce(F.bool_or(~is_special), F.lit(False)) & F.coalesce(F.bool_or(is_special & (F.col("similarity") > over)), F.lit(False))
    return best.agg((open_ & both & ~names_domain(F.lit(question))).alias("clarify"))


def degraded(keyword_fallback: Column, generation_failed: Column, embedding_missing: Column) -> Column:
    """The label of the worst step that a search fell back to; null if none."""
    return F.when(keyword_fallback, "keyword_fallback").when(generation_failed, "generation_fallback").when(embedding_missing, "embedding_unavailable")


def hydrated(chunks: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Content from the store where it was moved there (null or empty in place)."""
    away = stored.select(F.col(key), F.col("content").alias("stored_content"))
    return chunks.join(away, key, "left").withColumn("content", F.coalesce(F.nullif(F.col("content"), F.lit("")), F.col("stored_content"))).drop("stored_content")


def relevance_percent(score: str | Column) -> Column:
    """Rounded half up, as a whole number."""
    return F.floor((F.col(score) if isinstance(score, str) else score) * 100 + 0.5).cast("bigint")


def context(rows: DataFrame, most: int | None = 100_000) -> DataFrame:
    """One row, cut to `most` characters (None: whole; rows are a page's few): `[i] (exact)(relevance p %) title - heading`, a line break and the content of each row, blank lines between."""
    head = F.concat(F.lit("["), F.col("citation").cast("string"), F.lit("] "), F.when(F.col("is_direct"), "(exact) ").otherwise(""), F.lit("(relevance "), relevance_percent("similarity").cast("string"), F.lit(" %) "), F.concat_ws(" - ", "title", "heading"))
    parts = rows.select("citation", F.concat(head, F.lit("\n"), F.col("content")).alias("part"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("citation", "part"))), lambda x: x["part"]), "\n\n")
    return parts.agg((whole if most is None else F.substring(whole, 1, most)).alias("context"))


def citation_lookup(documents: DataFrame, chunks: DataFrame, number: int, year: int, paragraphs: Sequence[str], *, as_of: str | None = None, most_documents: int = 3, most_chunks: int = 10) -> DataFrame:
    """Chunks of the documents cited as number/year whose headings name one of the paragraphs; no paragraph, all chunks."""
    found = documents.filter(F.startswith(F.lower("external_id"), F.lit(f"{number}/{year}"))).filter(valid_at(as_of)).orderBy("external_id", "id").limit(most_documents)
    rows = chunks.join(F.broadcast(found.select(F.col("id").alias("document_id"), "title")), "document_id")  # most_documents rows
    if paragraphs:
        rows = rows.filter(F.rlike("heading", F.lit(r"(?iu)^§ (?:" + "|".join(paragraphs) + r")(?![0-9a-z])")))
    order = Window.partitionBy("document_id").orderBy("chunk_index", "id")
    return rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most_chunks).drop("n")
