"""Keyed state with timers: the pending flag of documents as their chunks change, and a rolling limit decided event by event.

State lies in RocksDB, on the executors' disks and in the checkpoint; a group's rows of a micro-batch come to its function
together, with its state: packed numbers, so that many small groups share an Arrow batch and none asks the JVM for its state.
What is kept for a group is bounded by what the group has (chunks of a document, events of a day).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DELETED, EMBEDDED, PENDING = 0, 1, 2
#: In place of a time that is null: before all others.
NO_TIME = -9_223_372_036_855


def use_rocksdb(spark: SparkSession) -> str | None:
    """Name the state store that these processors need, for streams that start from now on; what was set before."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    return before


def set_back(spark: SparkSession, before: str | None) -> None:
    """The state store that was named before."""
    spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _numbers(packed: bytes | bytearray, columns: int) -> np.ndarray:
    return np.frombuffer(bytes(packed), dtype=np.int64).reshape(-1, columns)


class PendingChunks:
    """The flag of one document: whether any of its chunks has no embedding.

    A chunk's row is what its event with the largest seq says: insert and update set it, pending unless it bears an embedding
    (unknown counts as pending); delete removes it. Events may come late and twice: one with a smaller seq than the chunk's
    changes nothing, also after a delete, which is remembered until `keep_ms` after its time.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def __call__(self, key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # chunk: (seq, state, time)
        known = {c: (q, s, at) for c, q, s, at in _numbers(state.get[0], 4).tolist()} if state.exists else {}
        came = False
        for part in rows if not state.hasTimedOut else ():
            came = came or len(part) > 0
            for chunk, seq, s, ms in zip(*[part[c].tolist() for c in ("chunk_id", "seq", "state", "ms")], strict=True):
                if chunk not in known or known[chunk][0] < seq:
                    known[chunk] = (seq, s, ms)
        states = [s for _, s, _ in known.values()]
        # deletes that nothing late can come before any more are forgotten
        passed = state.getCurrentWatermarkMs()
        known = {c: v for c, v in known.items() if v[1] != DELETED or v[2] + self.keep_ms > passed}
        state.update((np.array([(c, *v) for c, v in known.items()], dtype=np.int64).tobytes(),))
        if ends := [at + self.keep_ms for _, s, at in known.values() if s == DELETED]:
            state.setTimeoutTimestamp(min(ends))
        if came:
            n_pending = states.count(PENDING)
            yield pd.DataFrame({"document_id": [key[0]], "n_chunks": [len(states) - states.count(DELETED)], "n_pending": [n_pending], "pending": [n_pending > 0]})


def pending_chunks(events: DataFrame, late: str = "1 day", keep_ms: int = 86_400_000) -> DataFrame:
    """document_id, n_chunks, n_pending, pending of each document with events in a micro-batch, as it is after it.

    events: document_id, chunk_id, seq, op (insert, update, delete), embedded, at. Events later than `late` are dropped, so
    keep_ms should be as long at least. Needs use_rocksdb().
    """
    said = F.when(F.col("op") == "delete", DELETED).when(F.col("embedded"), EMBEDDED).otherwise(PENDING)
    rows = events.select("document_id", "chunk_id", "seq", said.alias("state"), F.coalesce(F.unix_millis("at"), F.lit(NO_TIME)).alias("ms"), "at").withWatermark("at", late)
    return rows.groupBy("document_id").applyInPandasWithState(PendingChunks(keep_ms), "document_id bigint, n_chunks bigint, n_pending bigint, pending boolean", "chunks binary", "update", GroupStateTimeout.EventTimeTimeout)


class RollingLimit:
    """Decisions on one user's events in the order of their times, whatever order they come in.

    Events wait until the watermark has passed them; then each is counted with those of the window that ends with it (events
    of the same time count for each other), and is allowed or refused. Times that no later window holds are forgotten.
    """

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window_us = limit, window_us

    def __call__(self, key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, before = (_numbers(state.get[0], 2), _numbers(state.get[1], 1)[:, 0]) if state.exists else (np.empty((0, 2), np.int64), np.empty(0, np.int64))
        came = [] if state.hasTimedOut else [part[["at_us", "event_id"]].to_numpy(np.int64) for part in rows]
        waiting = np.concatenate([waiting, *came])
        waiting = waiting[np.lexsort((waiting[:, 1], waiting[:, 0]))]
        n_due = int(np.searchsorted(waiting[:, 0], state.getCurrentWatermarkMs() * 1000, side="left"))
        due, rest = waiting[:n_due], waiting[n_due:]
        if n_due:
            new = due[:, 0]
            every = np.sort(np.concatenate([before, new]))
            n = np.searchsorted(every, new, side="right") - np.searchsorted(every, new - self.window_us, side="left")
            before = every[every >= new[-1] - self.window_us]
        state.update((rest.tobytes(), before.tobytes()))
        if len(rest):
            state.setTimeoutTimestamp(max(int(rest[0, 0]) // 1000, state.getCurrentWatermarkMs() + 1))
        if n_due:
            yield pd.DataFrame({"event_id": due[:, 1], "in_window": n.astype("int64"), "allowed": n <= self.limit})


def decided(events: DataFrame, limit: int, late: str = "1 day", window_us: int = 86_400_000_000) -> DataFrame:
    """event_id, in_window, allowed of each event, given once the watermark has passed it.

    events: event_id, user_id, at. in_window counts the user's events from window_us before it up to it, itself included, allowed
    or not. Events later than `late` are dropped; the last ones of a stream come out when a later event of any user (a
    heartbeat) moves the watermark. Needs use_rocksdb().
    """
    rows = events.selectExpr("event_id", "user_id", "at", "unix_micros(at) as at_us").withWatermark("at", late)
    return rows.groupBy("user_id").applyInPandasWithState(RollingLimit(limit, window_us), "event_id bigint, in_window bigint, allowed boolean", "waiting binary, times binary", "append", GroupStateTimeout.EventTimeTimeout)
