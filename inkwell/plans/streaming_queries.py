"""The streaming operators, run over the events table as a file stream until all that has landed is worked off."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.prefix import work_folder
from inkwell.plans.registry import query
from inkwell.streaming import usage


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.landed(spark, sf_dir, glob="events.parquet")


@query("stream_daily_counts", "select cast(ts::date as varchar) as day, user_id, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = work_folder(spark)
    latest = usage.daily_counts(_events(spark, sf_dir))
    usage.worked_off(latest, lambda df, n: df.write.mode("overwrite").parquet(f"{work}/out/v={n}"), f"{work}/check", "complete")
    return _last(spark, f"{work}/out").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "user_id", "event_type", "n", "total")


def _last(spark: SparkSession, path: str) -> DataFrame:
    """The newest of the snapshots that a stream's batches wrote."""
    rows = spark.read.parquet(path)
    newest = rows.agg(F.max("v")).first()[0]
    return rows.filter(F.col("v") == newest).drop("v")


@query("stream_deduplicated", "select event_type, count(distinct event_id) as n from events group by 1")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = work_folder(spark)
    events = _events(spark, sf_dir)
    twice = events.unionByName(_events(spark, sf_dir))
    usage.to_table(usage.once(twice, late="40 days").select("event_id", "event_type"), f"{work}/out", f"{work}/check")
    return spark.read.parquet(f"{work}/out").groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_pending", "select user_id, (count(*) filter (where event_type = 'error') - count(*) filter (where event_type = 'purchase'))::bigint as open, count(*) filter (where event_type = 'error') > count(*) filter (where event_type = 'purchase') as pending from events group by 1")
def stream_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = work_folder(spark)
    flags = usage.pending_flags(_events(spark, sf_dir))
    usage.worked_off(flags, lambda df, n: df.withColumn("b", F.lit(n)).write.mode("append").parquet(f"{work}/out"), f"{work}/check", "update")
    rows = spark.read.parquet(f"{work}/out")
    return rows.groupBy("user_id").agg(F.max_by(F.struct("open", "pending"), "b").alias("s")).select("user_id", "s.open", "s.pending")
