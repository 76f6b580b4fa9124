"""Bottom-k sketches of word shingles, in DataFrame operations only.

A document's fingerprint is the k smallest of the 64-bit hashes of its distinct shingles, in order. The k smallest of the
union of two sets are among their fingerprints, so fingerprints merge, over documents, parts and corpora, and the share of
those k that both have estimates their resemblance (standard error sqrt(r * (1 - r) / k); exact where the union has at most k).
The k-th smallest tells how many distinct shingles there are; hashes below both fingerprints' ends tell containment.

Shingles: words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, `width` in a row; a shorter text is one shingle, one without words none.
A word is hashed once, a shingle is the hash of its words' hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm import common
from inkwell.llm.audit import words_of

WIDTH = 5
SIZE = 128
#: Rows of a range of neighbours, about, and the most ranges (a power of two).
RANGE_ROWS = 256
MOST_RANGES = 1 << 14

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def hashes(text: Column, width: int = WIDTH) -> Column:
    """A hash for each shingle, in order, repeated ones too; null is an empty text."""
    words = words_of(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()))
    return F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(h) - width)), lambda i: F.when(F.size(h) < width, F.xxhash64(h)).otherwise(F.xxhash64(*[F.get(h, i + k) for k in range(width)])))
    ))[0]


def sketch(text: Column, size: int = SIZE, width: int = WIDTH) -> Column:
    """The `size` smallest hashes of the text's shingles, ascending; fewer where it has fewer, none without words."""
    return bottom(F.array_distinct(hashes(text, width)), size)


def bottom(values: Column, size: int = SIZE) -> Column:
    return F.slice(F.sort_array(values), 1, size)


def merged(a: Column, b: Column, size: int = SIZE) -> Column:
    """The sketch of the union of the sets of two sketches."""
    return bottom(F.array_union(a, b), size)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimate of |A and B| / |A or B|, 0 to 1; 1 for two sets without shingles, 0 if one has none."""
    union = merged(a, b, size)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.size(union)).cast("double")


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimate of |A and B| / |A|, 0 to 1: of A's hashes that B's sketch would have to hold, the share it holds; 1 where A is empty.

    Null where B's sketch ends before A's begins: then B is too large for the sketches to tell.
    """
    seen = F.when(F.size(b) < size, a).otherwise(F.filter(a, lambda x: x <= F.element_at(b, -1)))
    return F.when(F.size(a) == 0, 1.0).when(F.size(seen) > 0, F.size(F.array_intersect(seen, b)) / F.size(seen)).cast("double")


def distinct_count(a: Column, size: int = SIZE) -> Column:
    """Estimate of the number of distinct shingles: exact below `size`, else within about 1 / sqrt(size)."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise((size - 1) / share)


def written_out(a: Column) -> Column:
    """The sketch as a string: base64 of its hashes, 8 bytes each, without line breaks whatever the session's setting."""
    return F.translate(F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))), "\r\n", "")


def read_back(fingerprint: Column) -> Column:
    """The sketch of a string of written_out()."""
    digits = F.hex(F.unbase64(fingerprint))
    n = (F.length(digits) / 16).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.conv(F.substring(digits, i * 16 + 1, F.lit(16)), 16, -10).cast("bigint"))


def merged_by(rows: DataFrame, *parts: str, sketch: str = "sketch", size: int = SIZE) -> DataFrame:
    """One sketch for each part (columns `parts`): of the union of its rows' sets; null sketches count as empty.

    Hashes are made distinct with partial aggregation; each task then passes on the `size` smallest of a part at most (Spark
    puts the rank limit before the shuffle), so a part with any share of the rows is no hot key.
    """
    if clash := {sketch, "hash", "place"} & set(parts):
        raise ValueError(f"parts can't be called {clash}")
    each = rows.select(*parts, F.explode_outer(sketch).alias("hash")).groupBy(*parts, "hash").agg(F.lit(1).alias("one")).drop("one")
    place = F.row_number().over(Window.partitionBy(*parts).orderBy(F.col("hash").asc_nulls_last()))
    least = each.withColumn("place", place).filter(F.col("place") <= size)
    return least.groupBy(*parts).agg(F.sort_array(F.collect_list("hash")).alias(sketch))


def _range(key: Column, cuts: list) -> Column:
    """Number of cuts (descending) that are above or at the key: binary search in one literal; null is below all."""
    steps = max(1, len(cuts).bit_length())
    items = F.from_json(F.lit(str(cuts)), "array<bigint>")

    def step(low: Column, half: Column) -> Column:
        place = low + half
        return F.when((place <= len(cuts)) & F.coalesce(F.get(items, place - 1) >= key, F.lit(True)), place).otherwise(low)

    halves = F.array(*[F.lit(1 << k) for k in reversed(range(steps))])
    return F.aggregate(halves, F.lit(0), step)


def with_next(docs: DataFrame, text: str = "text", key: str = "doc_id", range_rows: int = RANGE_ROWS) -> DataFrame:
    """key, text (null: empty) and next_text of each row: that of the row after it by descending key; the first follows the last.

    Rows are dealt to ranges between sampled keys and sorted inside; the row at which a range begins goes to the range before it
    too, so that nobody looks across: texts move once. Null keys come last; rows of one key follow each other by text (one
    task sorts them, spilling); a single row follows itself. Keys are integers.
    """
    packed = common.Packed(docs)
    rows = packed.docs.select(packed.column(key).cast("bigint").alias("key"), F.coalesce(packed.column(text), F.lit("")).alias("text"))
    total, last = rows.agg(F.count("*"), F.max("key")).first()
    wanted = min(MOST_RANGES, max(1, total // range_rows))
    # about 16 sampled keys for each range; every 16th is a cut
    share = max(1, total // (16 * wanted))
    sampled = rows.select("key").filter(F.pmod(F.xxhash64("key"), F.lit(share)) == 0).filter("key is not null").distinct().orderBy(F.col("key").desc())
    drawn = [] if wanted == 1 else [r[0] for r in sampled.collect()]
    cuts = [k for k in drawn[8 :: max(1, len(drawn) // wanted)] if k != last]
    ranges = len(cuts) + 1
    here = _range(F.col("key"), cuts)
    begins = F.col("key").eqNullSafe(F.lit(last)) if last is not None else F.col("key").isNull()
    cut = F.get(F.from_json(F.lit(str(cuts)), "array<bigint>"), F.col("range") - 1)
    placed = rows.withColumn("range", here).withColumn("begins", F.coalesce(begins | (cut == F.col("key")), F.lit(False)))
    twice = F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("ahead")), F.struct(F.pmod(F.col("range") - 1, F.lit(ranges)).alias("range"), F.lit(True).alias("ahead")))
    once = F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("ahead")))
    dealt = placed.select("key", "text", F.explode(F.when(F.col("begins"), twice).otherwise(once)).alias("to")).select("key", "text", "to.*")
    return dealt.repartition("range")


def following() -> Window:
    """The window of with_next's rows in which the row after is the next one."""
    return Window.partitionBy("range").orderBy("ahead", F.col("key").desc_nulls_last(), "text")


def edited_pairs(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE, width: int = WIDTH, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of all texts and of their edited forms: key, n_chars, edited, sketch, edited_sketch, next_sketch.

    Edited: the last floor(n_chars / 3) code points give way to the first as many (or all) of the next text, descending key.
    Null is an empty text, whose sketch is empty; texts are read whole; repeated rows are rows of their own (see with_next);
    an empty table gives none; other columns are left out.
    """
    rows = with_next(docs, text, key, range_rows).withColumn("sketch", sketch(F.col("text"), size, width))
    rows = rows.withColumns({"next_text": F.lead("text").over(following()), "next_sketch": F.lead("sketch").over(following())})
    rows = rows.filter(~F.col("ahead"))
    n = F.length("text")
    gone = F.floor(n / 3).cast("int")
    edited = F.concat(F.left("text", n - gone), F.left(F.col("next_text"), gone))
    rows = rows.select("key", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    return rows.withColumn("edited_sketch", sketch(F.col("edited"), size, width))
