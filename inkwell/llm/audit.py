"""Filter interaction audit: what each filter of a chain removes, in every order of the filters, from one pass over the texts.

A document either fails a filter or doesn't; what a filter removes depends only on which filters came before it, not on their
order. So the walks through the orders are paths in the lattice of filter subsets: an edge (subset applied, next filter) says
how many documents the subset left and the next filter takes. n filters have n * 2^(n-1) edges (5: 80) and n! orders of n
steps (5: 600 steps); a step is a look-up of its edge.

Documents that fail the same filters contribute alike, so they are counted by failure pattern first (2^n rows for a part at
most, combined before the shuffle), then each pattern contributes to all edges, and the aggregated edges are joined to the
steps (n * n! rows, a fixed number: broadcast). Only keys, digests and patterns are shuffled, never texts.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm import common
from inkwell.llm.dedup import normalised

#: Whether a document fails, from its text (never null) and its words.
Failure = Callable[[Column, Column], Column]


def _n(words: Column) -> Column:
    return F.size(words).cast("long")


FILTERS: dict[str, Failure] = {
    "A": lambda text, words: _n(words) < 50,
    "B": lambda text, words: 100 * _n(F.array_distinct(words)) < 65 * _n(words),
    "C": lambda text, words: 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long") > 5 * F.length(text).cast("long"),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
#: The filter that fails copies.
COPIES = "E"


def words_of(text: Column) -> Column:
    """Maximal runs of [^\\x20\\x09-\\x0D] as an array; empty for a text without any."""
    body = F.trim(normalised(text))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, " ", -1))


def _bits(filters: Mapping[str, Failure], copies: str | None) -> dict[str, int]:
    names = sorted([*filters, *([copies] if copies else [])])
    if len(set(names)) < len(names) or not names or any(len(x) != 1 for x in names):
        raise ValueError("filters need different names of one character")
    return {name: 1 << k for k, name in enumerate(names)}


def patterns(
    docs: DataFrame, labels: DataFrame | None = None, filters: Mapping[str, Failure] = FILTERS, copies: str | None = COPIES,
    text: str = "text", key: str = "doc_id", part: str = "source",
) -> DataFrame:
    """Documents by part and failure pattern: part, fails (bits of the filters in order of their names), n, good, toxic.

    A copy is a text that a row with a smaller key has too, wherever it stands. Null texts are empty texts, and equal to them;
    a null part is the empty string. Null keys come after all others; rows that tie for the smallest key of a text are no
    copies. A document is good or toxic if any row of its key in `labels` (key, quality, toxic) says 1; null keys match none.
    """
    bits = _bits(filters, copies)
    packed = common.Packed(docs)
    rows = packed.docs.select(
        packed.column(key).alias("key"), F.coalesce(packed.column(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(packed.column(text), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("words", words_of(F.col("text")))
    fails = F.lit(0)
    for name, failure in filters.items():
        fails = fails.bitwiseOR(F.when(failure(F.col("text"), F.col("words")), bits[name]).otherwise(0))
    digest = F.unhex(F.sha2("text", 256)) if copies else F.lit(None).cast("binary")
    found = rows.select("key", "part", digest.alias("digest"), fails.cast("int").alias("fails"))
    found = found.groupBy("key", "part", "digest", "fails").agg(F.count("*").alias("n"))
    if labels is None:
        found = found.withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    else:
        mark = common.Packed(labels)
        marked = mark.docs.select(mark.column(key).alias("marked"), *[(mark.column(c) == 1).cast("int").alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
        marked = marked.filter("marked is not null").groupBy("marked").agg(F.coalesce(F.max("good"), F.lit(0)).alias("good"), F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic"))
        found = found.join(marked, F.col("key") == F.col("marked"), "left").drop("marked").fillna(0, ["good", "toxic"])
    sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")]
    if not copies:
        return found.groupBy("part", "fails").agg(*sums)
    # copies of a text fold to a row for each part and label; of these the rows with the smallest key are no copies
    folded = found.groupBy("digest", "part", "fails", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct(F.col("key").isNull(), F.col("key"), F.col("n"))).alias("first"))
    place = F.struct(F.col("first").getField("col1"), F.col("first").getField("key"))
    least = F.min(place).over(Window.partitionBy("digest"))
    folded = folded.select("part", "fails", "good", "toxic", "n", F.when(place.eqNullSafe(least), F.col("first").getField("n")).otherwise(0).alias("firsts"))
    folded = folded.groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n"), F.sum("firsts").alias("firsts"))
    both = F.explode(F.array(F.struct(F.col("fails"), F.col("firsts").alias("n")), F.struct(F.col("fails").bitwiseOR(bits[copies]).alias("fails"), (F.col("n") - F.col("firsts")).alias("n"))))
    split = folded.select("part", "good", "toxic", both.alias("x")).select("part", "good", "toxic", "x.fails", "x.n")
    return split.groupBy("part", "fails").agg(*sums)


def edges(found: DataFrame, names: str) -> DataFrame:
    """The lattice's edges for each part: before (bits of the filters applied), filter, and the counts of patterns()' rows.

    kept and removed: left by `before`, and passing or failing the filter; redundant: failing it, but gone before;
    unique_fails: failing this one only; good_lost and toxic_lost: those of removed; shapley: removed, summed over all orders.
    """
    n = len(names)
    lattice = [(before, k) for k in range(n) for before in range(1 << n) if not before >> k & 1]
    # one literal, not a tree of them
    every = F.from_json(F.lit(str([{"before": b, "k": k} for b, k in lattice]).replace("'", '"')), "array<struct<before:int,k:int>>")
    each = found.withColumn("edge", F.explode(every)).select("*", "edge.before", "edge.k", F.expr("shiftleft(1, edge.k)").alias("bit"))
    left = F.col("fails").bitwiseAND(F.col("before")) == 0
    failing = F.col("fails").bitwiseAND(F.col("bit")) != 0

    def total(when: Column, what: str = "n") -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(0))

    summed = each.groupBy("part", "before", "k").agg(
        total(left & ~failing).alias("kept"), total(left & failing).alias("removed"), total(~left & failing).alias("redundant"),
        total(F.col("fails") == F.col("bit")).alias("unique_fails"), total(left & failing, "good").alias("good_lost"), total(left & failing, "toxic").alias("toxic_lost"),
    )
    # an edge that s filters precede lies on s! * (n-1-s)! paths
    paths = F.element_at(F.array(*[F.lit(math.factorial(s) * math.factorial(n - 1 - s)) for s in range(n)]), F.bit_count("before") + 1)
    return summed.withColumn("shapley", F.sum(F.col("removed") * paths).over(Window.partitionBy("part", "k")))


def audit(
    docs: DataFrame, labels: DataFrame | None = None, filters: Mapping[str, Failure] = FILTERS, copies: str | None = COPIES,
    text: str = "text", key: str = "doc_id", part: str = "source",
) -> DataFrame:
    """A row for each part, order of all filters and step: part, filter_order, step (from 1), filter, and edges()' counts.

    Parts without documents have no rows, so an empty table has none; all counts of a part that has some are given, zeros too.
    Odd rows: see patterns(); columns beside those named are left alone, whatever they are called. Without labels good_lost
    and toxic_lost are 0. n filters give n * n! rows for a part: meant for a handful.
    """
    names = "".join(_bits(filters, copies))
    found = edges(patterns(docs, labels, filters, copies, text, key, part), names)
    steps = []
    for order in itertools.permutations(range(len(names))):
        before = 0
        for step, k in enumerate(order, 1):
            steps.append(("".join(names[x] for x in order), step, before, k))
            before |= 1 << k
    spark = docs.sparkSession
    paths = spark.createDataFrame(steps, "filter_order string, step int, b int, f int")
    joined = found.join(F.broadcast(paths), (F.col("before") == F.col("b")) & (F.col("k") == F.col("f")))
    letter = F.substring(F.lit(names), F.col("k") + 1, F.lit(1)).alias("filter")
    counts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return joined.select("part", "filter_order", "step", letter, *[F.col(c).cast("bigint").alias(c) for c in counts])
