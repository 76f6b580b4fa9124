"""Sources over landed files: gzip JSON lists, JSON-LD, pre-chunked standards, office documents, legacy encodings."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def json_items(spark: SparkSession, path: str, items: str = "položky", schema: str | None = None) -> DataFrame:
    """Rows of the list that a JSON document (gzip too) holds; give a schema for anything large, to spare a pass."""
    reader = spark.read.option("multiLine", True)
    whole = (reader.schema(schema) if schema else reader).json(path)
    return whole.select(F.explode(F.col(f"`{items}`")).alias("item")).select("item.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def decisions(rows: DataFrame) -> DataFrame:
    """JSON-LD decisions: key (file number, else case mark), matter, address, day."""
    key = F.coalesce(F.nullif(F.trim(F.col("`číslo_jednací`")), F.lit("")), F.nullif(F.trim(F.col("`spisová_značka`")), F.lit("")))
    out = rows.select(key.alias("external_id"), F.col("`věc`.cs").alias("title"), F.get(F.col("dokument.url"), F.lit(0)).alias("url"), F.try_to_date(F.col("`datum_právní_moci`.datum"), "yyyy-MM-dd").alias("decision_date"))
    return out.filter("external_id is not null")


def standards(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of pre-chunked standards: document columns, chunk_index, heading, content."""
    schema = "key string, source string, series string, external_id string, standard_name string, title string, url string, chunk_count int, chunks array<struct<heading:string,content:string>>"
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    return whole.select("key", "source", "series", "external_id", "title", "url", F.posexplode("chunks").alias("chunk_index", "chunk")).select("*", "chunk.heading", "chunk.content").drop("chunk")


def docx_text(data: bytes, cells: str = "\n") -> str:
    """Paragraphs, then the rows of tables with their different cells joined by `cells`."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_WORD}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{_WORD}t")).strip()
    parts = [said(p) for p in body.findall(f"{_WORD}p")]
    for row in body.iter(f"{_WORD}tr"):
        parts.append(cells.join(filter(None, dict.fromkeys(said(c) for c in row.findall(f"{_WORD}tc")))))
    return "\n".join(filter(None, parts))


@F.pandas_udf(T.StringType())
def _docx(data: pd.Series, cells: pd.Series) -> pd.Series:
    def read(x, between):
        try:
            return None if x is None else docx_text(x, between)
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError):
            return None

    return pd.Series([read(x, between) for x, between in zip(data, cells, strict=True)], dtype=object)


def docx(column: str | Column, most: int | None = 100_000, cells: str = " | ") -> Column:
    """Text of a .docx up to `most` characters (None: all), `cells` between the cells of a table's row; null for what is none."""
    out = _docx(F.col(column) if isinstance(column, str) else column, F.lit(cells))
    return out if most is None else F.substring(out, 1, most)


@F.pandas_udf(T.StringType())
def _decoded(data: pd.Series) -> pd.Series:
    def read(x):
        try:
            plain = x.decode("utf-8")
        except UnicodeDecodeError:
            plain = None
        # bytes that are valid UTF-8 with letters beyond ASCII are no text of windows-1250 in any language
        return plain if plain is not None else x.decode("cp1250", "replace")

    return data.map(read, na_action="ignore")


@F.pandas_udf(T.StringType())
def _decoded_old_first(data: pd.Series) -> pd.Series:
    def read(x):
        try:
            return x.decode("cp1250")
        except UnicodeDecodeError:
            return x.decode("utf-8", "replace")

    return data.map(read, na_action="ignore")


def decoded(column: str | Column, old_first: bool = False) -> Column:
    """UTF-8 if it is that, else windows-1250; old_first: windows-1250, and UTF-8 only for bytes that it doesn't have."""
    return (_decoded_old_first if old_first else _decoded)(F.col(column) if isinstance(column, str) else column)


def days(spark: SparkSession, path: str, schema: str, first: str, last: str, day: str = "day") -> DataFrame:
    """JSON pages landed in folders by day, from first to last; other days' folders aren't read."""
    return spark.read.schema(f"{schema}, {day} string").json(path).filter(F.col(day).between(first, last))


def sql_values(spark: SparkSession, statements: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Rows of the VALUES lists of INSERT statements, a file's text to a row; quotes are doubled in texts, null is null.

    schema: the columns in their order, as DDL.
    """
    fields = T.StructType.fromDDL(schema)
    one = r"(?:'[^']*+(?:''[^']*+)*+'|[^,()']+)"
    row = rf"\(\s*({one}(?:\s*,\s*{one})*)\s*\)"
    body = F.regexp_replace(column, r"(?is)^.*?\bvalues\b", "")
    cells = F.regexp_extract_all("r", F.lit(rf"\s*({one})\s*(?:,|$)"), F.lit(1))
    rows = statements.select(F.explode(F.regexp_extract_all(body, F.lit(row), F.lit(1))).alias("r")).select(cells.alias("c"))

    def value(k: int, kind) -> Column:
        raw = F.trim(F.get("c", F.lit(k)))
        quoted = F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit("''"), F.lit("'"))
        return F.when(F.lower(raw) == "null", None).when(F.startswith(raw, F.lit("'")), quoted).otherwise(raw).cast(kind)

    return rows.select(*[value(k, f.dataType).alias(f.name) for k, f in enumerate(fields)])


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def sections(pages: DataFrame, heading: str, most: int, *, document: str = "document_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """Pages from the first that has the heading, until `most` characters are reached (the page that crosses it included)."""
    from pyspark.sql import Window

    order = Window.partitionBy(document).orderBy(page)
    begun = F.max(F.rlike(text, F.lit(heading)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = pages.withColumn("begun", begun).filter("begun = 1").drop("begun")
    before = F.coalesce(F.sum(F.length(text)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("before", before).filter(F.col("before") < most).drop("before")


def columns_of(df: DataFrame) -> list[tuple[str, str, bool]]:
    """name, type and nullability of each column."""
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]


def ad_hoc(spark: SparkSession, sql: str, most: int | None = 20) -> DataFrame:
    """The first `most` rows (None: all) of a reading statement, for administrators."""
    if not re.match(r"(?is)\s*(select|with|describe|show|explain)\b", sql):
        raise ValueError("only reading statements are run")
    return spark.sql(sql) if most is None else spark.sql(sql).limit(most)
