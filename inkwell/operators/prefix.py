"""Running sums over a whole table or over groups of any size, without a task that holds them.

Rows are dealt by ranges of the order and written once, so that their places are fixed; each range sums its own rows and adds
what comes before it, which is a sum over few rows: one for each range and group that meets it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ranges and groups whose sums may be broadcast: under 100 bytes each.
BROADCAST_ROWS = 100_000


def work_folder(spark: SparkSession, name: str = "work") -> str:
    """A new folder below that of spark.checkpoint.dir; where it is unset, on one machine only, one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="inkwell-work-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def running(rows: DataFrame, amount: Column, *order: Column | str, group: Sequence[str] = (), name: str = "before") -> DataFrame:
    """rows with the sum of the amounts of the rows before each in the order, within its group; the order must be total."""
    spark = rows.sparkSession
    path = work_folder(spark, "ranges")
    dealt = rows.withColumn("__amount", amount).repartitionByRange(*[F.col(g) for g in group], *order).withColumn("__part", F.spark_partition_id())
    dealt.write.parquet(path)
    placed = spark.read.schema(dealt.schema).parquet(path)
    by = [F.col(g) for g in group]
    sums = placed.groupBy(*by, "__part").agg(F.sum("__amount").alias("__sum"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(g).alias(f"__g{k}") for k, g in enumerate(group)], F.col("__part").alias("__p"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"))
    starts = F.broadcast(starts) if starts.count() <= BROADCAST_ROWS else starts
    same = F.col("__part") == F.col("__p")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{k}"))
    inside = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("__inner", F.coalesce(F.sum("__amount").over(inside), F.lit(0))).join(starts, same)
    return out.withColumn(name, F.col("__start") + F.col("__inner")).select(*rows.columns, name)
