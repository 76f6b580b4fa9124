"""Structured Streaming over usage events: incremental polling, tumbling and rolling counts, keyed pending state, re-delivery.

Every source is a file stream with a given schema; availableNow works off what has landed and stops, so a rerun goes on
from the checkpoint and does nothing twice. Checkpoints belong in a folder that all executors share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import store

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def landed(spark: SparkSession, folder: str, schema: str = EVENTS, *, files_at_once: int = 1000, glob: str = "*.parquet", cleanup: str = "off") -> DataFrame:
    """Events of the Parquet files in a folder, `files_at_once` in each micro-batch; `at` is their time."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", glob).option("cleanSource", cleanup).parquet(folder)
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events of each user and type by day; a day closes when the watermark passes it."""
    return events.withWatermark("at", late).groupBy(F.window("at", "1 day").alias("w"), "user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("day"), "user_id", "event_type", "n", "total")


def rolling_counts(events: DataFrame, window: str = "24 hours", step: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("at", late).groupBy(F.window("at", window, step).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.end").alias("until"), "user_id", "n")


def step_counts(events: DataFrame, step: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each user by step, `until` its end: one state for an event, where rolling_counts has one for each window it is in."""
    return events.withWatermark("at", late).groupBy(F.window("at", step).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.end").alias("until"), "user_id", "n")


def rolled(counts: DataFrame, steps: int, step: str = "1 hour") -> DataFrame:
    """The rows of rolling_counts, with windows of so many steps, from stored step_counts; a row for each step and user.

    Where counts are dealt by user, windows are made and summed where they lie.
    """
    until = F.col("until") + F.expr(f"interval {step}") * F.col("__later")
    each = counts.withColumn("__later", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).select(until.alias("until"), "user_id", "n")
    return each.groupBy("until", "user_id").agg(F.sum("n").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("begun"), F.col("w.end").alias("ended"), "user_id", "n")


def once(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Re-delivered events go, within the watermark's bound on state."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def pending_flags(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(user_id, open, pending) as it changes: errors open an item, purchases close one; the state is one number a user."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (open_,) = state.get if state.exists else (0,)
        for part in parts:
            open_ += int((part["event_type"] == "error").sum()) - int((part["event_type"] == "purchase").sum())
        state.update((open_,))
        yield pd.DataFrame({"user_id": [key[0]], "open": [open_], "pending": [open_ > 0]})

    return events.select("user_id", "event_type").groupBy("user_id").applyInPandasWithState(update, "user_id bigint, open bigint, pending boolean", "open bigint", "update", "NoTimeout")


def worked_off(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run what has landed through to a sink for micro-batches, then stop."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Append what has landed to a Parquet table, exactly once."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", path).start().awaitTermination()


def upserted_by_batch(path: str, key: str, order: str, buckets: int = 1024) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the newest row of each key in a Store at `path`: a batch rewrites the buckets that its keys are in.

    A row that comes late never replaces a newer one; of rows that tie the one that was there stays. A batch that is repeated
    after a failure is done once, as its commit bears its number.
    """

    def sink(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        try:
            kept = store.Store.opened(batch.sparkSession, path)
        except AnalysisException as error:  # the first batch makes the table
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            store.Store.created(newest.limit(0), path, key, buckets)
            kept = store.Store.opened(batch.sparkSession, path)
        kept.changed(lambda old: _newer(old, newest, key, order), newest, name=f"batch-{number}")

    return sink


def _newer(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    both = old.withColumn("__place", F.lit(1)).unionByName(new.withColumn("__place", F.lit(0)))
    best = F.max_by(F.struct(*[F.col(c) for c in old.columns]), F.struct(order, "__place"))
    return both.groupBy(F.col(key).alias("__key")).agg(best.alias("r")).select("r.*")
