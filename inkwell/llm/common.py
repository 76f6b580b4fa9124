"""Shared folder, written tables and small helpers of the training-data operators.

Lineage is cut by writing Parquet tables below the folder that the session names in
spark.checkpoint.dir: all executors see it, so a lost executor loses nothing of them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that Spark puts into one Arrow batch; a batch is held by one worker as a whole.
BATCH_ROWS = 256


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (tests, one machine), a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="inkwell-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
    """df as a Parquet table of the shared folder, read again with the schema it had; in a folder for each value of `by`, if given.

    Column names that clash or that Parquet forbids are no matter: operators give their own names here.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    out = df.write.option("compression", codec)
    (out.partitionBy(by) if by else out).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._inkwell_path = path  # for dropped()
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_inkwell_path", None):
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the Arrow batch of the session to `rows` rows, so that a batch of long texts fits a worker."""
    if int(spark.conf.get(ARROW_ROWS)) > rows or int(spark.conf.get(ARROW_ROWS)) <= 0:
        spark.conf.set(ARROW_ROWS, str(rows))


def by_bytes(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts have about `limit` bytes; one longer text is a run of its own."""
    import numpy as np

    texts = batch.column(column)
    if batch.num_rows == 0:
        return
    ends = np.cumsum(lengths(texts))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, base + limit, side="right"))
        stop = max(stop, start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def lengths(texts: pa.Array):
    """Bytes of each text; 0 for null."""
    import numpy as np
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)


def gathered(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches regrouped to about `limit` bytes of text each, whole rows, in order."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in by_bytes(batch, column, limit):
            n = int(lengths(part.column(column)).sum())
            if held and size + n > limit:
                yield joined(held)
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield joined(held)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.Table.from_batches(batches).combine_chunks().to_batches(max_chunksize=None)[0]


class Packed:
    """The columns of a table by place, so that names don't matter: spaces, dots, repeated names and any case.

    rows() has the text (or None) and the others as one struct `row`; columns() gives them back under their names, but for
    those in `without` (compared as Spark does, without case), which the operator replaces or leaves out.
    """

    def __init__(self, docs: DataFrame, without: tuple[str, ...] = ()):
        self.names = docs.columns
        self.docs = docs.toDF(*[f"c{k}" for k in range(len(self.names))])
        gone = {x.lower() for x in without}
        self.kept = [k for k, name in enumerate(self.names) if name.lower() not in gone]

    def column(self, name: str) -> Column:
        return F.col(f"c{self.place(name)}")

    def place(self, name: str) -> int:
        """Place of the column of that name: written the same if there is one, else the one that differs in case only."""
        found = [k for k, x in enumerate(self.names) if x == name] or [k for k, x in enumerate(self.names) if x.lower() == name.lower()]
        if not found:
            raise ValueError(f"there is no column {name} among {self.names}")
        return found[0]

    def row(self) -> Column:
        # a struct needs a field
        return F.struct(*[F.col(f"c{k}") for k in self.kept], *([] if self.kept else [F.lit(True).alias("none")])).alias("row")

    def rows(self, text: str | None = None, *more: Column) -> DataFrame:
        return self.docs.select(*([self.column(text).alias("text")] if text else []), self.row(), *more)

    def schema(self, more: str) -> StructType:
        """The row's type and the columns of a DDL string after it."""
        kind = self.rows().schema["row"].dataType
        return StructType([StructField("row", kind), *StructType.fromDDL(more).fields])

    def columns(self) -> list[Column]:
        return [F.col("row").getField(f"c{k}").alias(self.names[k]) for k in self.kept]


def clash_free(names: list[str], wanted: str) -> str:
    """`wanted`, or the same with underscores appended until no column (whatever the case) is called so."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
