"""A stored inverted index: which documents have a word, without reading a text.

Postings are Parquet rows (block, term, n, first, ids): of the documents of one block - `span` neighbouring keys - those that
have the term, as ascending offsets, delta-coded in the file, with their number and the smallest. They lie in folders
segment=<s>/part=<p> by a hash of the term and are sorted by it there, so that a search reads the parts of its words and, by
the files' statistics, little of these. A word that every document has is as many rows as there are blocks.

An index grows by segments: what is added later is a segment of its own, and its documents are dead in all segments before.
A segment counts when its line in `segments` is there, which is written last; what a failed job leaves is named by none.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text as texts

_POSTING = "block bigint, term string, n int, first int, ids array<int>, segment int, part int"
_LISTED = "n_documents bigint, n_dead bigint, folder string, segment int"
_DEAD = "id bigint, segment int"
#: Rows of a look at the minima that the driver takes.
MOST_BLOCKS = 100_000


@dataclass(frozen=True)
class Index:
    """An index by integer keys. Parts and span are fixed when it is made; it holds no state beside the folder."""

    spark: SparkSession
    path: str
    parts: int
    span: int

    @classmethod
    def created(cls, spark: SparkSession, path: str, parts: int = 256, span: int = 1 << 16) -> Index:
        spark.createDataFrame([(parts, span)], "parts int, span int").coalesce(1).write.mode("errorifexists").parquet(f"{path}/about")
        return cls.opened(spark, path)

    @classmethod
    def opened(cls, spark: SparkSession, path: str) -> Index:
        about = spark.read.schema("parts int, span int").parquet(f"{path}/about").first()
        return cls(spark, path.rstrip("/"), about["parts"], about["span"])

    # ---- growing ----

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text", *, new: bool = False) -> int:
        """Index some documents as a segment; its number. Those that are indexed already are replaced.

        new: none of them is, which spares the list of dead ones. A null text has no words; rows without a key aren't found;
        rows of one key are one document with the words of all.
        """
        rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).filter("id is not null")
        block = F.floor(F.col("id") / self.span).cast("bigint")
        each = rows.select(block.alias("block"), (F.col("id") - block * self.span).cast("int").alias("at"), F.explode(F.array_distinct(texts.words("text"))).alias("term"))
        # at most `span` offsets in a group, whatever the word
        found = each.groupBy("term", "block").agg(F.sort_array(F.collect_set("at")).alias("ids"))
        segment = self._next()
        self._write(found, segment)
        dead = rows.select("id").distinct()
        return self._listed(segment, dead, not new and segment > 1)

    def remove(self, ids: DataFrame, key: str = "doc_id") -> int:
        """Documents that no search finds any more: a segment without words; its number."""
        dead = ids.select(F.col(key).cast("bigint").alias("id")).filter("id is not null").distinct()
        segment = self._next()
        self._write(self.spark.createDataFrame([], "term string, block bigint, ids array<int>"), segment)
        return self._listed(segment, dead, True)

    def merged(self, path: str) -> Index:
        """A new index of what is alive here, as one segment, made from the postings alone."""
        other = Index.created(self.spark, path, self.parts, self.span)
        rows = self._postings().select("segment", "block", "term", "ids")
        if not self._segments().filter("n_dead > 0").isEmpty():
            # lists stay whole: what is dead of a segment's block is a bit for each offset
            rows = rows.join(self._dead_bits(), ["segment", "block"], "left")
            bit = lambda at: F.getbit(F.get("dead", F.shiftright(at, 6)), at.bitwiseAND(F.lit(63)))
            rows = rows.withColumn("ids", F.when(F.col("dead").isNull(), F.col("ids")).otherwise(F.filter("ids", lambda at: bit(at) == 0))).filter(F.size("ids") > 0)
        # at most `span` offsets of each segment in a group
        found = rows.groupBy("term", "block").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
        other._write(found, 1)
        other._listed(1, self.spark.createDataFrame([], "id bigint"), False)
        return other

    # ---- asking ----

    def documents(self, terms: Sequence[str], every: bool = False) -> DataFrame:
        """id of each document that has any (every: all) of the words, once. Without words none (every: an error)."""
        wanted = sorted({t.lower() for t in terms})
        if every and not wanted:
            raise ValueError("all of no words are all documents: an index doesn't know them")
        return self._ids(self._matched(self._of(wanted), [F.col("term") == t for t in wanted], every))

    def containing(self, pieces: Sequence[str], every: bool = False) -> DataFrame:
        """id of each document in which any (every: all) of the pieces is part of a word: every part's words are looked through."""
        wanted = sorted({p.lower() for p in pieces})
        if not wanted:
            raise ValueError("no pieces are asked for")
        tests = [F.contains("term", F.lit(p)) for p in wanted]
        any_ = tests[0]
        for t in tests[1:]:
            any_ = any_ | t
        return self._ids(self._matched(self._postings().filter(any_), tests, every))

    def first(self, terms: Sequence[str], k: int) -> DataFrame:
        """The k smallest ids of documents(): blocks are read up to that in which, by their numbers, the k-th must be met."""
        wanted = sorted({t.lower() for t in terms})
        rows = self._of(wanted)
        dead = self._segments().agg(F.coalesce(F.sum("n_dead"), F.lit(0))).first()[0]
        if k + dead <= MOST_BLOCKS:
            # a block has as many documents at least as its most frequent word; a row for each block
            least = rows.groupBy("segment", "block").agg(F.max("n").alias("n")).groupBy("block").agg(F.max("n").alias("n")).orderBy("block").limit(k + dead).collect()
            met = 0
            for r in least:
                met += r["n"]
                if met >= k + dead:
                    rows = rows.filter(F.col("block") <= r["block"])
                    break
        return self._ids(self._matched(rows, [F.col("term") == t for t in wanted], False)).orderBy("id").limit(k)

    def counts(self, terms: Sequence[str]) -> DataFrame:
        """term, n: in how many documents a word is; those dead in a later segment don't count."""
        each = self._of(sorted({t.lower() for t in terms})).select("segment", "block", "term", F.explode("ids").alias("at"))
        return self._alive(each).groupBy("term").agg(F.count("*").alias("n"))

    # ---- inside ----

    def _next(self) -> int:
        try:
            listed = self._segments().agg(F.max("segment")).first()[0]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            listed = None
        return (listed or 0) + 1

    def _segments(self) -> DataFrame:
        return self.spark.read.schema(_LISTED).parquet(f"{self.path}/segments")

    def _part(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.parts)).cast("int")

    def _write(self, found: DataFrame, segment: int) -> None:
        rows = found.select("block", "term", F.size("ids").alias("n"), F.get("ids", F.lit(0)).alias("first"), "ids", self._part(F.col("term")).alias("part"))
        dealt = rows.hint("rebalance", "part").sortWithinPartitions("part", "term", "block")
        # Parquet's second format codes integers as differences
        out = dealt.write.mode("overwrite").option("parquet.writer.version", "v2").option("parquet.enable.dictionary#ids.list.element", "false").option("compression", "zstd")
        out.partitionBy("part").parquet(f"{self.path}/postings/segment={segment}")

    def _listed(self, segment: int, ids: DataFrame, dead: bool) -> int:
        folder = f"{self.path}/dead/segment={segment}"
        (ids if dead else ids.limit(0)).write.mode("overwrite").parquet(folder)
        n = ids.count()
        line = self.spark.createDataFrame([(n, n if dead else 0, folder)], "n_documents bigint, n_dead bigint, folder string")
        line.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/segments/segment={segment}")
        return segment

    def _postings(self) -> DataFrame:
        """The postings of the segments that are listed; a number for each segment."""
        known = sorted(r[0] for r in self._segments().select("segment").collect())
        return self.spark.read.schema(_POSTING).option("mergeSchema", False).parquet(f"{self.path}/postings").filter(F.col("segment").isin(known))

    def _of(self, terms: list[str]) -> DataFrame:
        if not terms:
            return self._postings().filter("false")
        wanted = self.spark.createDataFrame([(t,) for t in terms], "t string").select(self._part(F.col("t")).alias("p")).distinct().collect()
        return self._postings().filter(F.col("part").isin(sorted(r[0] for r in wanted)) & F.col("term").isin(terms))

    def _matched(self, rows: DataFrame, tests: Sequence[Column], every: bool) -> DataFrame:
        """segment, block, at: of each block united or intersected; no more than `span` offsets a word are held at once."""
        if not every:
            return rows.select("segment", "block", F.explode("ids").alias("at")).distinct()
        lists = [F.array_distinct(F.flatten(F.collect_list(F.when(t, F.col("ids"))))).alias(f"l{k}") for k, t in enumerate(tests)]
        both = rows.groupBy("segment", "block").agg(*lists)
        met = F.col("l0")
        for k in range(1, len(tests)):
            met = F.array_intersect(met, F.col(f"l{k}"))
        return both.select("segment", "block", F.explode(met).alias("at"))

    def _replaced(self) -> DataFrame:
        """__id, __last: the last segment that replaces a document."""
        dead = self.spark.read.schema(_DEAD).parquet(f"{self.path}/dead").join(F.broadcast(self._segments().select("segment")), "segment", "left_semi")
        return dead.groupBy(F.col("id").alias("__id")).agg(F.max("segment").alias("__last"))

    def _dead_bits(self) -> DataFrame:
        """segment, block, dead: a bit for each offset, 64 in a number, set where a later segment replaces the document."""
        block = F.floor(F.col("__id") / self.span).cast("bigint")
        ids = self._replaced().select(block.alias("block"), (F.col("__id") - block * self.span).cast("int").alias("at"), "__last")
        words = ids.groupBy("block", "__last", F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, at & 63)")).alias("bits"))
        each = words.join(F.broadcast(self._segments().select("segment")), F.col("segment") < F.col("__last")).groupBy("segment", "block", "word").agg(F.bit_or("bits").alias("bits"))
        none = each.select("segment", "block").distinct().select("segment", "block", F.explode(F.sequence(F.lit(0), F.lit((self.span - 1) // 64))).alias("word"), F.lit(0).cast("bigint").alias("bits"))
        whole = each.unionByName(none).groupBy("segment", "block", "word").agg(F.bit_or("bits").alias("bits"))
        return whole.groupBy("segment", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("dead"))

    def _alive(self, rows: DataFrame) -> DataFrame:
        """Rows (segment, block, at, ...) but for documents that a later segment replaces."""
        if not self._segments().filter("n_dead > 0").isEmpty():
            here = F.col("block") * self.span + F.col("at")
            rows = rows.join(self._replaced(), (here == F.col("__id")) & (F.col("segment") < F.col("__last")), "left_anti")
        return rows

    def _ids(self, rows: DataFrame) -> DataFrame:
        return self._alive(rows).select((F.col("block") * self.span + F.col("at")).alias("id")).distinct()


def staged(index: Index, exact: DataFrame, terms: Sequence[str], *, whole_words: bool = True) -> DataFrame:
    """id, stage, match of the first stage that finds a document: the ids of `exact` (cislo), all words (fulltext), any (fulltext_volne)."""
    ask = index.documents if whole_words else index.containing
    numbered = exact.select(F.col(exact.columns[0]).cast("bigint").alias("id"), F.lit(0).alias("stage"))
    found = numbered.unionByName(ask(terms, every=True).withColumn("stage", F.lit(1))).unionByName(ask(terms).withColumn("stage", F.lit(2)))
    best = found.groupBy("id").agg(F.min("stage").alias("stage"))
    return best.withColumn("match", F.get(F.array(*[F.lit(x) for x in ("cislo", "fulltext", "fulltext_volne")]), F.col("stage")))
