"""Lists inside large JSON documents, read as a stream: a Python data source with early exit.

A document like {"položky": [{...}, {...}, ...], ...}, gzip too, is one value to Spark's own JSON reader. Here a task reads a
file piece by piece, cuts the list's items out of it and gives them on in batches; what is held is one piece and one item,
however long the list. Items come as text, so their columns are Spark's own from_json. Other members are passed over.

Wanted keys are given, or come as a condition on the key column (equality or a list of values) where
spark.sql.python.filterPushdown.enabled is set: only such items leave the source, and where keys are unique the rest of a
file isn't read once each of them has been seen. Each row bears the bytes of its file that had been read for it, and all.
"""

from __future__ import annotations

import codecs
import itertools
import json
import zlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

PIECE = 1 << 20
#: Rows and bytes of a batch, about.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

_SPACE = " \t\r\n"


class _Text:
    """A text that arrives in pieces, with a place in it; what lies before the place is forgotten."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.decoder = iter(pieces), codecs.getincrementaldecoder("utf-8-sig")()
        self.text, self.at, self.done = "", 0, False
        self.scan = json.JSONDecoder().raw_decode

    def more(self, least: int = 1) -> None:
        """Take pieces for at least so many characters more; the last ones if there are fewer."""
        parts, n = [self.text[self.at :]], 0
        while n < least and not self.done:
            piece = next(self.pieces, None)
            self.done = piece is None
            part = self.decoder.decode(piece or b"", self.done)
            parts.append(part)
            n += len(part)
        self.text, self.at = "".join(parts), 0

    def peek(self) -> str:
        """The next character that is no white space; empty at the end."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in _SPACE:
                self.at += 1
            if self.at < len(self.text):
                return self.text[self.at]
            if self.done:
                return ""
            self.more()

    def take(self, wanted: str) -> bool:
        """Pass over this character if it is the next one."""
        if self.peek() != wanted:
            return False
        self.at += 1
        return True

    def expect(self, wanted: str) -> None:
        if not self.take(wanted):
            raise ValueError(f"JSON: {wanted!r} is missing before {self.text[self.at : self.at + 20]!r}")

    def value(self) -> tuple[object, str]:
        """The next value, and its text. If it isn't all there, twice as much text is taken before it is tried again."""
        self.peek()
        while True:
            try:
                found, end = self.scan(self.text, self.at)
            except json.JSONDecodeError:
                if self.done:
                    raise
            else:
                # a number may go on in the next piece, also after what isn't its end ("1." of "1.5")
                whole = self.done or (end < len(self.text) and (type(found) not in (int, float) or self.text[end] in _SPACE + ",]}"))
                if whole:
                    start, self.at = self.at, end
                    return found, self.text[start:end]
            self.more(len(self.text) - self.at)

    def skip(self) -> None:
        """Pass over a value; of a list or an object one member is held at a time."""
        if self.take("["):
            for _ in self.members("]"):
                self.value()
        elif self.take("{"):
            for _ in self.members("}"):
                self.value()
                self.expect(":")
                self.value()
        else:
            self.value()

    def members(self, end: str) -> Iterator[None]:
        """Once for each member of the list or object that has been entered; the caller takes the member."""
        if self.take(end):
            return
        while True:
            yield None
            if self.take(end):
                return
            self.expect(",")


def items(pieces: Iterable[bytes], field: str | None) -> Iterator[tuple[object, str]]:
    """The items of the list that the document has under a name (None: that it is), each with its text.

    A document without the name, or where it is null, has no items; what follows the list is not looked at.
    """
    text = _Text(pieces)
    if field is not None:
        text.expect("{")
        found = False
        for _ in text.members("}"):
            name, _ = text.value()
            text.expect(":")
            found = name == field
            if found:
                break
            text.skip()
        if not found or text.peek() == "n":
            return
    text.expect("[")
    for _ in text.members("]"):
        yield text.value()


def unpacked(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip file's pieces, of all its members, in pieces of bounded size; others as they are."""
    rest = iter(pieces)
    head = b""
    while len(head) < 2 and (piece := next(rest, None)) is not None:
        head += piece
    unzip = zlib.decompressobj(31) if head[:2] == b"\x1f\x8b" else None
    for piece in itertools.chain([head], rest):
        if unzip is None:
            yield piece
            continue
        while piece:
            yield unzip.decompress(piece, PIECE)
            piece = unzip.unconsumed_tail
            if unzip.eof:  # another member may follow, or zeros that fill a block
                piece = unzip.unused_data.lstrip(b"\0")
                unzip = zlib.decompressobj(31)
    if unzip is not None and (last := unzip.flush()):
        yield last


def chosen(found: Iterator[tuple[object, str]], key: str | None, wanted: frozenset[str] | None, unique: bool) -> Iterator[tuple[str | None, str]]:
    """Key (as text) and text of the items whose key is wanted (None: all); unique: no more is asked for when all were seen."""
    left = set(wanted or ())
    for item, text in found:
        name = item.get(key) if key is not None and isinstance(item, dict) else None
        name = name if name is None or isinstance(name, str) else json.dumps(name)
        if wanted is None or name in wanted:
            yield name, text
            left.discard(name)
        if wanted is not None and unique and not left:
            return


class _File(InputPartition):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size


class ListReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.field, self.key = options["path"], options.get("field"), options.get("key")
        self.unique = options.get("unique", "false").lower() == "true"
        self.wanted = frozenset(json.loads(options["wanted"])) if "wanted" in options else None

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(self.path if ":/" in self.path else f"file://{self.path}")
        one = files.get_file_info(path)
        found = [one] if one.type == fs.FileType.File else files.get_file_info(fs.FileSelector(path, recursive=True))
        return [_File(x.path, x.size) for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        if self.wanted is not None and not self.wanted:
            return
        files, _ = fs.FileSystem.from_uri(self.path if ":/" in self.path else f"file://{self.path}")
        read = [0]
        names = ["key", "value", "file", "bytes_read", "bytes"]
        rows: list[tuple] = []
        size = 0

        def pieces() -> Iterator[bytes]:
            with files.open_input_stream(partition.path, compression=None) as stream:
                while piece := stream.read(PIECE):
                    read[0] += len(piece)
                    yield piece

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for key, text in chosen(items(unpacked(pieces()), self.field), self.key, self.wanted, self.unique):
            rows.append((key, text, partition.path, read[0], partition.size))
            size += len(text)
            if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


class FilteredListReader(ListReader):
    """Takes conditions on the key from Spark; it may be used only where Spark's setting for that is on."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take conditions on the key; all others, and those that can't be met here, go back to Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("key",):
                values = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f


class JsonLists(DataSource):
    """format("json_list"): options path (a file, or a folder of files), field (the list's name; none: the document is it),
    key (the member that identifies an item), unique (no two items of a file have the same key), wanted (a JSON list of
    keys: no other items), pushdown (conditions on the key are taken from Spark)."""

    @classmethod
    def name(cls) -> str:
        return "json_list"

    def schema(self) -> str:
        return "key string, value string, file string, bytes_read bigint, bytes bigint"

    def reader(self, schema: StructType) -> ListReader:
        options = dict(self.options)
        return (FilteredListReader if options.get("pushdown") == "true" else ListReader)(options)


def json_list(spark: SparkSession, path: str, field: str | None, key: str | None = None, unique: bool = False, wanted: Sequence[str] | None = None) -> DataFrame:
    """Items as key, value (JSON text), file, bytes_read and bytes; a row for each, in no order. wanted: only those of these keys."""
    spark.dataSource.register(JsonLists)
    given = {"field": field, "key": key, "wanted": None if wanted is None else json.dumps(list(wanted))}
    options = {k: v for k, v in given.items() if v is not None} | {"path": path, "unique": str(unique).lower(), "pushdown": spark.conf.get(PUSHDOWN, "false").lower()}
    return spark.read.format("json_list").options(**options).load()


def wanted_items(spark: SparkSession, path: str, field: str | None, key: str, schema: str, wanted: DataFrame, most_listed: int = 100_000) -> DataFrame:
    """The items whose key is in the one column of `wanted`, with the columns of the schema; keys are unique in a file.

    Up to most_listed different keys (counted) go to the source, which then reads no further than it must; more are joined, and
    files are read whole.
    """
    keys = wanted.select(F.col(wanted.columns[0]).cast("string").alias("wanted")).filter("wanted is not null").distinct()
    listed = [r[0] for r in keys.limit(most_listed + 1).collect()]
    if len(listed) > most_listed:
        rows = json_list(spark, path, field, key).join(keys, F.col("key") == F.col("wanted"), "left_semi")
    else:
        rows = json_list(spark, path, field, key, unique=True, wanted=listed)
    return rows.select(F.from_json("value", schema).alias("item")).select("item.*")
