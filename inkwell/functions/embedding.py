"""Vectors from a service that is plugged in: any function from texts to vectors, called on Arrow batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column
from pyspark.sql import functions as F


class KeySpent(Exception):
    """The service takes no more calls with this key for now."""


class AllSpent(Exception):
    """No key is left: what is asked from here on has no vector, without a call."""


class Rotation:
    """A service that is called with one of several keys: call(key, texts).

    Each call takes the key after the last one's; a task begins at a key of its own, so that tasks don't ask with one key at
    once. A key whose call raises KeySpent is not used again by the task, and its texts are asked with the next.
    """

    def __init__(self, keys: Sequence[str], call: Callable[[str, list[str]], Sequence[Sequence[float]]]):
        if not keys:
            raise ValueError("a rotation needs a key")
        self.keys, self.call = list(keys), call
        self.left: list[str] | None = None

    def __call__(self, texts: list[str]) -> Sequence[Sequence[float]]:
        if self.left is None:
            task = TaskContext.get()
            first = task.partitionId() % len(self.keys) if task else 0
            self.left = self.keys[first:] + self.keys[:first]
        while self.left:
            key = self.left.pop(0)
            try:
                found = self.call(key, texts)
            except KeySpent:
                continue
            except Exception:
                self.left.append(key)
                raise
            self.left.append(key)
            return found
        raise AllSpent


#: What a call takes: characters of a text and texts at once.
MOST = 8000
AT_ONCE = 20


def embedded(text: Column, call: Callable[[list[str]], Sequence[Sequence[float]]], *, most: int | None = MOST, at_once: int = AT_ONCE, attempts: int = 3, wait: float = 1.0) -> Column:
    """array<double> for each text: call(texts) for at_once texts at a time, cut to `most` characters (None: whole).

    Null and blank texts have no vector. A call that raises is tried again after a wait that doubles; after `attempts` its
    texts have none, and the row stays in the queue of rows without one. Once a call raises AllSpent the task makes no more.
    """
    over = []

    def asked(texts: list[str]) -> list:
        for attempt in range(0 if over else attempts):
            try:
                return [[float(x) for x in v] for v in call(texts)]
            except AllSpent:
                over.append(True)
                break
            except Exception:
                if attempt + 1 < attempts:
                    time.sleep(wait * 2**attempt)
        return [None] * len(texts)

    @F.arrow_udf("array<double>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out: list = [None] * len(batch)
            part: list[tuple[int, str]] = []  # no more texts than a call takes are strings at once
            for first in range(0, len(batch), at_once):
                for k, said in enumerate(batch.slice(first, at_once).to_pylist(), first):
                    if said is not None and said.strip():
                        part.append((k, said))
                    if part and (len(part) == at_once or k + 1 == len(batch)):
                        for (place, _), vector in zip(part, asked([t for _, t in part]), strict=True):
                            out[place] = vector
                        part = []
            yield pa.array(out, pa.list_(pa.float64()))

    return embed(text if most is None else F.substring(text, 1, most))
