"""Splitting texts into chunks.

Packing is a fold over the parts of a text (`aggregate`), so it stays in the JVM; only the cut that looks back for the best
place in a sliding window is a pandas UDF, on Arrow batches. All return array<string>; chunk_rows() makes rows of them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parts(text: str | Column, pattern: str) -> Column:
    """Trimmed, non-empty parts between matches of a pattern."""
    return F.filter(F.transform(F.split(_col(text), pattern), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def fixed(text: str | Column, size: int) -> Column:
    """Slices of `size` characters."""
    n = F.ceil(F.length(_col(text)) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(_col(text), i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def packed(pieces: Column, most: int, joiner: str, counted: int) -> Column:
    """Pieces joined greedily up to `most` characters, `counted` of them for each joiner; a longer piece is a chunk of its own."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("size"))

    def add(state: Column, piece: Column) -> Column:
        full = (state["open"] != "") & (state["size"] + F.length(piece) + counted > most)
        return F.struct(
            F.when(full, F.array_append(state["done"], state["open"])).otherwise(state["done"]).alias("done"),
            F.when(full | (state["open"] == ""), piece).otherwise(F.concat(state["open"], F.lit(joiner), piece)).alias("open"),
            F.when(full | (state["open"] == ""), F.length(piece)).otherwise(state["size"] + F.length(piece) + counted).alias("size"),
        )

    return F.aggregate(pieces, empty, add, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])))


def _or(chunks: Column, fallback: Column) -> Column:
    return F.when(F.size(chunks) > 0, chunks).otherwise(fallback)


def paragraphs(text: str | Column, most: int = 1500) -> Column:
    """Greedy over paragraphs; separators count, a longer paragraph stays whole."""
    return packed(parts(text, "\n\n"), most, "\n\n", 2)


def paragraphs_loose(text: str | Column, most: int = 3000, slices: bool = True) -> Column:
    """Greedy over paragraphs, separators not counted; without any, slices or the text as it is."""
    return _or(packed(parts(text, "\n\n"), most, "\n\n", 0), fixed(text, most) if slices else F.array(_col(text)))


def paragraphs_cut(text: str | Column, most: int = 3000) -> Column:
    """As paragraphs_loose, but a longer paragraph is cut into slices that no other paragraph joins."""
    # cuts of a long paragraph are marked so that packing never joins them to anything
    marked = F.flatten(F.transform(parts(text, "\n\n"), lambda p: F.when(F.length(p) > most, F.transform(fixed(p, most), lambda s: F.struct(s.alias("text"), F.lit(True).alias("cut")))).otherwise(F.array(F.struct(p.alias("text"), F.lit(False).alias("cut"))))))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("size"))

    def add(state: Column, piece: Column) -> Column:
        full = (state["open"] != "") & (piece["cut"] | (state["size"] + F.length(piece["text"]) > most))
        done = F.when(full, F.array_append(state["done"], state["open"])).otherwise(state["done"])
        joins = (state["open"] != "") & ~full
        return F.struct(
            F.when(piece["cut"], F.array_append(done, piece["text"])).otherwise(done).alias("done"),
            F.when(piece["cut"], "").when(joins, F.concat(state["open"], F.lit("\n\n"), piece["text"])).otherwise(piece["text"]).alias("open"),
            F.when(piece["cut"], 0).when(joins, state["size"] + F.length(piece["text"])).otherwise(F.length(piece["text"])).alias("size"),
        )

    chunks = F.aggregate(marked, empty, add, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])))
    return _or(chunks, F.array(F.substring(_col(text), 1, most)))


def lines(text: str | Column, most: int = 4000) -> Column:
    """Greedy over lines, one character for each break; a text of blank lines only is cut to its first characters."""
    empty = F.array().cast("array<string>")
    return F.when(F.coalesce(F.length(_col(text)), F.lit(0)) == 0, empty).otherwise(_or(packed(parts(text, "\n"), most, "\n", 1), F.array(F.substring(_col(text), 1, most))))


def titled(title: str | Column, text: str | Column, most: int = 1400) -> Column:
    """Greedy over lines; the title heads the first chunk unless it is in it; a text without lines is its title."""
    chunks = _or(packed(parts(F.coalesce(_col(text), F.lit("")), "\n"), most, "\n", 1), F.array(F.coalesce(_col(title), F.lit(""))))
    first = F.get(chunks, F.lit(0))
    headed = (F.coalesce(_col(title), F.lit("")) != "") & ~F.contains(first, _col(title))
    return F.when(headed, F.concat(F.array(F.concat(_col(title), F.lit("\n"), first)), F.slice(chunks, 2, F.greatest(F.size(chunks), F.lit(1))))).otherwise(chunks)


def blank_line_paragraphs(text: str | Column, most: int = 4000) -> Column:
    """Greedy over paragraphs between blank lines; whatever gets longer is cut hard and goes on from the cut."""
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, piece: Column) -> Column:
        full = (state["open"] != "") & (F.length(state["open"]) + 2 + F.length(piece) > most)
        whole = F.when(full | (state["open"] == ""), piece).otherwise(F.concat(state["open"], F.lit("\n\n"), piece))
        done = F.when(full, F.array_append(state["done"], trimmed(state["open"]))).otherwise(state["done"])
        return F.struct(done.alias("done"), whole.alias("open"))

    def cut(state: Column) -> Column:
        n = F.greatest(F.floor((F.length(state["open"]) - 1) / most), F.lit(0)).cast("int")
        slices = F.transform(F.sequence(F.lit(0), n - 1), lambda k: trimmed(F.substring(state["open"], k * most + 1, F.lit(most))))
        return F.when(n == 0, state).otherwise(F.struct(F.concat(state["done"], slices).alias("done"), F.substring(state["open"], n * most + 1, F.length(state["open"])).alias("open")))

    bound = lambda state, piece: F.element_at(F.transform(F.array(add(state, piece)), cut), 1)
    chunks = F.aggregate(parts(text, r"\n\s*\n"), empty, bound, lambda s: F.array_append(s["done"], trimmed(s["open"])))
    return F.filter(chunks, lambda c: c != "")


def sliding(text: str | Column, most: int = 4000) -> Column:
    """Cut at the last paragraph end of each window, else the last sentence end, else the last space, if past a quarter of it; else hard."""
    return _sliding(_col(text), F.lit(most))


def hard_chunks(text: str, most: int) -> list[str]:
    import re

    done: list[str] = []
    open_ = ""
    for piece in filter(None, (p.strip() for p in re.split(r"\n\s*\n", text.strip()))):
        if open_ and len(open_) + 2 + len(piece) > most:
            done.append(open_.strip())
            open_ = piece
        else:
            open_ = "\n\n".join(filter(None, (open_, piece)))
        at = 0
        while len(open_) - at > most:
            done.append(open_[at : at + most].strip())
            at += most
        open_ = open_[at:]
    return [c for c in [*done, open_.strip()] if c]


def sliding_chunks(text: str, most: int) -> list[str]:
    whole, done, at = text.strip(), [], 0
    least = most // 4
    while len(whole) - at > most:
        end = at + most
        ends = ((whole.rfind("\n\n", at, end), 0), (whole.rfind(". ", at, end), 1), (whole.rfind(" ", at, end), 0))
        cut = next((place + more for place, more in ends if place - at >= least), end)
        done.append(whole[at:cut].strip())
        at = cut
        while at < len(whole) and whole[at] in " \n":
            at += 1
    return [c for c in [*done, whole[at:].strip()] if c]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _sliding(text: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else sliding_chunks(t, m) for t, m in zip(text, most, strict=True)])


def chunk_rows(docs: DataFrame, chunks: Column, *keys: str, most: int | None = 8000) -> DataFrame:
    """keys, chunk_index (from 0) and content of each chunk, cut to `most` characters (what a longer chunk has beyond is lost; None: whole)."""
    rows = docs.select(*keys, F.posexplode(chunks).alias("chunk_index", "content"))
    return rows if most is None else rows.withColumn("content", F.substring("content", 1, most))


def capped(text: str | Column, most: int | None = 200_000) -> Column:
    """The first `most` characters of a report (None: all)."""
    return _col(text) if most is None else F.substring(_col(text), 1, most)


def continued_headings(title: Column, index: Column, word: str = "pokracovani") -> Column:
    """The title, and from the second part on `title (word n)`."""
    return F.when(index > 0, F.concat(title, F.lit(f" ({word} "), (index + 1).cast("string"), F.lit(")"))).otherwise(title)


def part_headings(title: Column, n: Column, index: Column, word: str = "part") -> Column:
    """`word i/n` for texts of several chunks, null for one."""
    return F.when(n > 1, F.concat_ws("", F.lit(word + " "), (index + 1).cast("string"), F.lit("/"), n.cast("string")))
