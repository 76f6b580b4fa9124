"""Functions that SQL can call: searches and chunkers that return rows.

register() makes them for a session, over views of documents and chunks:

    select * from match_chunks(query_embedding => array(...), match_count => 5, p_as_of => date'2024-01-01')
    select d.id, c.* from documents d, lateral fixed_chunks(d.text, 3000) c
    select * from sliding_chunks(table(select id, text from documents), 'text', 4000)

match_chunks and fixed_chunks are SQL functions: Spark puts their bodies into the query and plans the whole. sliding_chunks and
paragraph_chunks are Python table functions with a table argument: rows stream through, nothing is shuffled, and analyze()
gives the columns and refuses what can't work before anything runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from inkwell.functions import chunking


def _chunker(cut: Callable[[str, int], list[str]]):
    """The table function of a chunker: all columns of the table, chunk_index (from 0) and content of each chunk of one column."""

    class Chunks:
        @staticmethod
        def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable or not isinstance(rows.dataType, StructType):
                raise ValueError("the first argument must be a table")
            names = [f.name for f in rows.dataType.fields]
            if not column.isConstantExpression or column.value not in names or rows.dataType[column.value].dataType != StringType():
                raise ValueError(f"the second argument must name a string column among {names}")
            if not most.isConstantExpression or most.value is None or most.value < 1:
                raise ValueError("the third argument must be a length of at least 1")
            if clash := {"chunk_index", "content"} & {n.lower() for n in names}:
                raise ValueError(f"columns can't be called {sorted(clash)}")
            return AnalyzeResult(StructType([*rows.dataType.fields]).add("chunk_index", IntegerType()).add("content", StringType()))

        def eval(self, row: Row, column: str, most: int) -> Iterator[tuple]:
            for number, chunk in enumerate(cut(row[column], most) if row[column] is not None else ()):
                yield (*row, number, chunk)

    return Chunks


SlidingChunks = _chunker(chunking.sliding_chunks)
ParagraphChunks = _chunker(chunking.hard_chunks)

#: Names and defaults are those of the function that the search calls.
MATCH_CHUNKS = """
create or replace temporary function match_chunks(
  query_embedding array<double>, match_count int default 8, min_similarity double default 0.55, p_as_of date default null, p_doc_types array<string> default null)
returns table(chunk_id bigint, document_id bigint, heading string, content string, similarity double, doc_title string, doc_url string, doc_type string)
return
  with scored as (
    select c.id as chunk_id, c.document_id, c.heading, c.content, d.title as doc_title, d.url as doc_url, d.doc_type,
           aggregate(zip_with(cast(c.embedding as array<double>), match_chunks.query_embedding, (x, y) -> x * y), 0d, (t, x) -> t + x)
           / nullif(sqrt(aggregate(cast(c.embedding as array<double>), 0d, (t, x) -> t + x * x)) * sqrt(aggregate(match_chunks.query_embedding, 0d, (t, x) -> t + x * x)), 0d) as similarity
    from {chunks} c join {documents} d on d.id = c.document_id
    where c.embedding is not null and size(c.embedding) = size(match_chunks.query_embedding)
      and (case when match_chunks.p_as_of is null then d.is_current
           else (d.valid_from is null or d.valid_from <= match_chunks.p_as_of) and (d.valid_until is null or match_chunks.p_as_of <= d.valid_until) end)
      and (match_chunks.p_doc_types is null or array_contains(match_chunks.p_doc_types, d.doc_type))),
  ranked as (select *, row_number() over (order by similarity desc, chunk_id) as place from scored where similarity >= match_chunks.min_similarity)
  select chunk_id, document_id, heading, content, similarity, doc_title, doc_url, doc_type from ranked where place <= match_chunks.match_count"""

FIXED_CHUNKS = """
create or replace temporary function fixed_chunks(text string, most int)
returns table(chunk_index int, content string)
return select pos, col from (select posexplode(transform(
  case when length(fixed_chunks.text) > 0 then sequence(0, cast(ceil(length(fixed_chunks.text) / fixed_chunks.most) as int) - 1) else array() end,
  i -> substring(fixed_chunks.text, i * fixed_chunks.most + 1, fixed_chunks.most))))"""


def register(spark: SparkSession, documents: str | None = None, chunks: str | None = None) -> None:
    """Make the functions for the session; match_chunks only where its two views (or tables) are named.

    documents: id, title, url, doc_type, is_current, valid_from, valid_until. chunks: id, document_id, heading, content, embedding.
    """
    spark.sql(FIXED_CHUNKS)
    for name, chunker in (("sliding_chunks", SlidingChunks), ("paragraph_chunks", ParagraphChunks)):
        spark.udtf.register(name, udtf(chunker, useArrow=True))
    if documents and chunks:
        spark.sql(MATCH_CHUNKS.format(documents=documents, chunks=chunks))
