"""Benchmark decontamination with training suffix arrays.

Training documents are cut into shards of at most 2^20 words, whole documents each (one longer document is cut with an
overlap). For each shard a suffix array over its words is sorted by prefix doubling, each round one sort of packed
64-bit keys, down to the depth of a test window. Every window at every test suffix is binary-searched in it (all at
once, vectorised); occurrences are confirmed on 64-bit hashes of the words. Consecutive windows along one diagonal join to
the longest verbatim matches, with their locations in the document and in the test item. Shards are independent:
nothing is shuffled, and a lost task is repeated on its own. Test items are sent to the workers in blocks of bounded size,
one at a time: with more than one, a pass over the rows is written before the next block is read, so the driver and a worker
hold one block. A worker indexes a block once, whatever number of tasks it runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from inkwell.llm import common, textkit

WINDOW = 13
SHARD_BYTES = 4 << 20
#: Bytes of test texts that go to the workers at once.
BLOCK_BYTES = 32 << 20
POSITION_BITS = 20
CODE_BITS = 22
SPAN = "item_id string, item_word bigint, doc_word bigint, n_words bigint"


def codes(hashes: np.ndarray) -> np.ndarray:
    """The letters that suffixes are sorted by: 1 to 2^22 - 1; 0 is the end of a document."""
    return np.maximum(hashes >> np.uint64(64 - CODE_BITS), np.uint64(1))


@dataclass
class Windows:
    """Distinct test windows of one length: hashes (n, length), where each begins first, and the items that hold it."""

    length: int
    hashes: np.ndarray
    place: np.ndarray  # the first one; item words numbered through all items, so that neighbours differ by 1
    owner_ends: np.ndarray
    owners: np.ndarray


@dataclass
class TestIndex:
    """Item names, their windows, and the words of all items by place, a 0 after each item."""

    ids: np.ndarray
    groups: list[Windows]
    words: np.ndarray
    item: np.ndarray  # by place
    word: np.ndarray  # by place


def index_items(ids: list[str], texts: pa.Array, window: int = WINDOW) -> TestIndex:
    """Windows of all items; an item of fewer words than a window is one window, an item of none has none."""
    hashes, first = textkit.hashed_words(texts, textkit.LETTERS)
    names = np.array(sorted(set(ids)), dtype=object)
    number = {x: k for k, x in enumerate(names)}
    item_of = np.array([number[x] for x in ids], dtype=np.int64)
    counts = np.diff(first)
    hashes = np.maximum(hashes, np.uint64(1))
    base = first[:-1] + np.arange(len(counts))  # a gap between items
    words = np.zeros(len(hashes) + len(counts) + 1, dtype=np.uint64)
    words[np.arange(len(hashes)) + np.repeat(np.arange(len(counts)), counts)] = hashes
    item = np.repeat(item_of, counts + 1)
    word = np.arange(len(item)) - np.repeat(base, counts + 1)
    groups = []
    for length in sorted({min(int(n), window) for n in counts if n}):
        members = np.flatnonzero(counts >= window if length == window else counts == length)
        per = counts[members] - length + 1
        owner = np.repeat(members, per)
        at = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        rows = hashes[(first[owner] + at)[:, None] + np.arange(length)]
        order = np.lexsort((at, owner, *rows.T[::-1]))
        rows, owner, at = rows[order], owner[order], at[order]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        heads = np.flatnonzero(new)
        groups.append(Windows(length, rows[heads], base[owner[heads]] + at[heads], np.append(heads[1:], len(rows)), item_of[owner]))
    return TestIndex(names, groups, words, item, word)


def suffix_array(letters: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of `letters` in the order of their first `depth` letters (ties by place), and the sorted keys of their first two.

    Doubling: the rank of a suffix is where its group of equals begins; only groups of more than one are sorted again.
    """
    n = len(letters)
    place = np.uint64(POSITION_BITS)
    low = np.uint64((1 << POSITION_BITS) - 1)
    second = np.zeros(n, dtype=np.uint64)
    second[:-1] = letters[1:]
    keys = np.sort((letters << np.uint64(CODE_BITS) | second) << place | np.arange(n, dtype=np.uint64))
    order = (keys & low).astype(np.int64)
    group = keys >> place
    new = textkit.heads(group)
    rank = np.zeros(2 * n + 1, dtype=np.uint64)
    sorted_rank = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = sorted_rank
    done = 2
    while done < depth:
        last = np.ones(n, dtype=bool)
        last[:-1] = new[1:]
        tied = np.flatnonzero(~(new & last))
        if not len(tied):
            break
        at = order[tied]
        packed = np.sort(rank[at] << np.uint64(2 * POSITION_BITS) | rank[np.minimum(at + done, 2 * n)] << place | at.astype(np.uint64))
        order[tied] = (packed & low).astype(np.int64)
        new[tied] |= textkit.heads(packed >> place)
        sorted_rank = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = sorted_rank
        done *= 2
    return order, keys


def search(letters: np.ndarray, order: np.ndarray, keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of `wanted` (letters of one window) the range of `order` whose suffixes begin with it."""
    length = wanted.shape[1]
    place, code = np.uint64(POSITION_BITS), np.uint64(CODE_BITS)
    if length == 1:
        begin = wanted[:, 0] << (place + code)
        end = (wanted[:, 0] + np.uint64(1)) << (place + code)
    else:
        begin = (wanted[:, 0] << code | wanted[:, 1]) << place
        end = begin + (np.uint64(1) << place)
    low, high = np.searchsorted(keys, begin), np.searchsorted(keys, end)
    if length == 1:
        high = np.where(wanted[:, 0] == (1 << CODE_BITS) - 1, len(keys), high)
    if length <= 2:
        return low, high
    padded = np.concatenate([letters, np.zeros(length, dtype=letters.dtype)])
    steps = np.arange(2, length)

    def bound(strict: bool) -> np.ndarray:
        left, right = low.copy(), high.copy()
        open_ = np.flatnonzero(left < right)
        while len(open_):
            middle = (left[open_] + right[open_]) // 2
            have = padded[order[middle][:, None] + steps]
            want = wanted[open_, 2:]
            differ = have != want
            where = differ.argmax(axis=1)
            rows = np.arange(len(open_))
            found = differ[rows, where]
            before = np.where(found, have[rows, where] < want[rows, where], not strict)
            left[open_[before]] = middle[before] + 1
            right[open_[~before]] = middle[~before]
            open_ = open_[left[open_] < right[open_]]
        return left

    return bound(True), bound(False)


def occurrences(hashes: np.ndarray, test: TestIndex) -> Iterator[tuple[Windows, np.ndarray, np.ndarray]]:
    """For each window length: places in the shard (in order) and the number of the window there. hashes: 0 ends a document."""
    letters = np.where(hashes == 0, np.uint64(0), codes(hashes))
    size = 1 << POSITION_BITS
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in test.groups]
    widest = max((g.length for g in test.groups), default=1)
    for start in range(0, max(len(hashes) - widest + 1, 1), size - widest + 1):
        part = letters[start : start + size]
        own = len(part) if start + size >= len(hashes) else size - widest + 1
        order, keys = suffix_array(part, widest)
        for k, g in enumerate(test.groups):
            low, high = search(part, order, keys, codes(g.hashes))
            hit = np.flatnonzero(high > low)
            n = (high - low)[hit]
            window = np.repeat(hit, n)
            at = order[np.repeat(low[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            window, at = window[at < own], at[at < own]
            whole = at + start + g.length <= len(hashes)
            window, at = window[whole], at[whole] + start
            same = (hashes[at[:, None] + np.arange(g.length)] == g.hashes[window]).all(axis=1)
            found[k].append((at[same], window[same]))
    for g, parts in zip(test.groups, found, strict=True):
        at, window = (np.concatenate(x) for x in zip(*parts, strict=True))
        by_place = np.argsort(at, kind="stable")
        yield g, at[by_place], window[by_place]


@dataclass
class Found:
    n_words: np.ndarray
    n_hit: np.ndarray
    span_doc: np.ndarray
    span_item: np.ndarray
    span_item_word: np.ndarray
    span_doc_word: np.ndarray
    span_words: np.ndarray
    item_doc: np.ndarray
    item: np.ndarray


def scan(texts: pa.Array, test: TestIndex, before: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> Found:
    """Matches of one shard of texts. before: (document, first word, words) of spans that count as hit already."""
    words, first = textkit.hashed_words(texts, textkit.LETTERS)
    words = np.maximum(words, np.uint64(1))
    n_docs = len(first) - 1
    base = first[:-1] + np.arange(n_docs)
    hashes = np.zeros(len(words) + n_docs, dtype=np.uint64)
    hashes[np.arange(len(words)) + np.repeat(np.arange(n_docs), np.diff(first))] = words
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    spans: list[tuple] = []
    items: list[np.ndarray] = []
    for g, at, window in occurrences(hashes, test) if len(words) else ():
        np.add.at(edge, at, 1)
        np.add.at(edge, at + g.length, -1)
        doc = np.searchsorted(base, at, side="right") - 1
        place = g.place[window]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1] + 1) | (doc[1:] != doc[:-1])
        heads = np.flatnonzero(new)
        run = np.diff(np.append(heads, len(at)))
        begin, item_place, n = _extended(hashes, test.words, at[heads], place[heads], run + g.length - 1)
        spans.append((doc[heads], test.item[item_place], test.word[item_place], begin - base[doc[heads]], n))
        pairs = textkit.distinct(doc << 32 | window)
        pair_doc, pair_window = pairs >> 32, pairs & 0xFFFFFFFF
        begin = np.where(pair_window > 0, g.owner_ends[pair_window - 1], 0)
        n = g.owner_ends[pair_window] - begin
        owner = g.owners[np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        items.append(np.repeat(pair_doc, n) << 32 | owner)
    if before is not None:
        doc, word, n = before
        np.add.at(edge, base[doc] + word, 1)
        np.add.at(edge, base[doc] + word + n, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    n_hit = covered[base + np.diff(first)] - covered[base]
    joined = [np.concatenate(x) for x in zip(*spans, strict=True)] if spans else [np.zeros(0, dtype=np.int64)] * 5
    if len(joined[0]):
        # runs of one match, found apart, are one once they are extended
        joined = list(np.unique(np.stack([joined[0], joined[3], joined[1], joined[2], joined[4]]), axis=1)[[0, 2, 3, 1, 4]])
    by_doc = np.lexsort((joined[3], joined[0]))
    pairs = textkit.distinct(np.concatenate(items)) if items else np.zeros(0, dtype=np.int64)
    return Found(np.diff(first), n_hit, *(x[by_doc] for x in joined), pairs >> 32, pairs & 0xFFFFFFFF)


def _extended(hashes: np.ndarray, words: np.ndarray, at: np.ndarray, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches (place in the shard, place among the items, words) made as long as they go in both, to the left and right."""
    at, place, n = at.copy(), place.copy(), n.copy()
    open_ = np.arange(len(at))
    while len(open_):
        left = (at[open_] > 0) & (place[open_] > 0)
        same = left & (hashes[at[open_] - 1] == words[place[open_] - 1]) & (hashes[at[open_] - 1] > 0)
        open_ = open_[same]
        at[open_] -= 1
        place[open_] -= 1
        n[open_] += 1
    open_ = np.arange(len(at))
    while len(open_):
        ends, item_ends = at[open_] + n[open_], place[open_] + n[open_]
        inside = (ends < len(hashes)) & (item_ends < len(words))
        open_, ends, item_ends = open_[inside], ends[inside], item_ends[inside]
        open_ = open_[(hashes[ends] == words[item_ends]) & (hashes[ends] > 0)]
        n[open_] += 1
    return at, place, n


def _lists(doc: np.ndarray, n_docs: int, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n_docs + 1)).astype(np.int32)), values)


def _blocks(benchmark: DataFrame, item_key: str, item_text: str) -> tuple[int, Callable[[int], pa.Table]]:
    """The number of blocks of test items with text, of about BLOCK_BYTES each, and a function that fetches one."""
    packed = common.Packed(benchmark)
    items = packed.docs.select(F.coalesce(packed.column(item_key).cast("string"), F.lit("")).alias("id"), packed.column(item_text).alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + int(total) // BLOCK_BYTES
    return blocks, lambda k: items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).toArrow()


def matched(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """For each row of docs: `row` (its columns by place: c0, c1, ...), n_words, n_hit, items (ids, sorted as strings), spans.

    A span is a longest verbatim match: item, word of the item, word of the document, words. Where several items share a
    passage, it names the first of them; `items` has them all. Null texts have no words. Texts of any length are searched
    whole. Repeated rows are matched each by itself; null item texts are no items; a null item id is an empty string; items
    with one id are one item of several texts. Columns may have any names. Empty tables give no rows or no matches.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    packed = common.Packed(docs)
    row_type = packed.rows().schema["row"].dataType
    at = packed.place(text)
    rows = packed.rows()
    n, fetch = _blocks(benchmark, item_key, item_text)
    for k in range(n):
        shared = spark.sparkContext.broadcast(fetch(k))
        passed = _pass(rows, shared, row_type, at, window)
        if k == n - 1:
            return passed
        before, rows = rows, common.written(passed, "decontam-pass")
        common.dropped(before)
        shared.destroy()


#: The block that this worker has used last, with its index.
_INDEX: list = []


def _indexed(shared, window: int) -> TestIndex:
    block = shared.value  # the same object in all tasks of a worker
    if not _INDEX or _INDEX[0] is not block or _INDEX[1] != window:
        _INDEX[:] = block, window, index_items(block["id"].to_pylist(), block["text"].combine_chunks(), window)
    return _INDEX[2]


def _pass(rows: DataFrame, shared, row_type, at: int, window: int) -> DataFrame:
    again = "items" in rows.columns
    spans = ", ".join(x.replace(" ", ":") for x in SPAN.split(", "))
    schema = StructType([StructField("row", row_type), *StructType.fromDDL(f"n_words bigint, n_hit bigint, items array<string>, spans array<struct<{spans}>>").fields])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = _indexed(shared, window)
        for batch in batches:
            texts = batch.column("row").field(at)
            for part in common.gathered(iter([pa.RecordBatch.from_arrays([texts, *batch.columns], names=["text", *batch.schema.names])]), 0, SHARD_BYTES):
                yield _matched_batch(part, test, again)

    return rows.mapInArrow(match, schema)


def _matched_batch(part: pa.RecordBatch, test: TestIndex, again: bool) -> pa.RecordBatch:
    n = part.num_rows
    before, old_items, old_spans = None, [[]] * n, [[]] * n
    if again:
        old_items, old_spans = part.column("items").to_pylist(), part.column("spans").to_pylist()
        flat = [(k, s["doc_word"], s["n_words"]) for k, x in enumerate(old_spans) for s in x]
        before = tuple(np.array(x, dtype=np.int64) for x in zip(*flat, strict=True)) if flat else None
    found = scan(part.column(0), test, before)
    names = pa.array(test.ids[found.item], pa.string())
    spans = pa.StructArray.from_arrays(
        [pa.array(test.ids[found.span_item], pa.string()), *(pa.array(x.astype(np.int64)) for x in (found.span_item_word, found.span_doc_word, found.span_words))],
        names=[x.split(" ")[0] for x in SPAN.split(", ")],
    )
    items, span_lists = _lists(found.item_doc, n, names), _lists(found.span_doc, n, spans)
    if again:
        items = pa.array([sorted({*a, *b}) for a, b in zip(old_items, items.to_pylist(), strict=True)], items.type)
        span_lists = pa.array([a + b for a, b in zip(old_spans, span_lists.to_pylist(), strict=True)], span_lists.type)
    columns = {"row": part.column("row"), "n_words": pa.array(found.n_words.astype(np.int64)), "n_hit": pa.array(found.n_hit.astype(np.int64)), "items": items, "spans": span_lists}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def contaminated() -> Column:
    """At least one word is hit, and at least a twentieth of all words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns; see matched()."""
    return matched(docs, benchmark, **options).filter(~contaminated()).select(*common.Packed(docs).columns())
