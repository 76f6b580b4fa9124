"""Chat formatting: a finite-state machine over roles and a declarative template.

A conversation becomes one text: its turns are streamed in order through the machine (nothing of a conversation is held but
its state and a piece of output), so conversations may have any number of turns. Each turn gives segments of text - marker,
body, end - each with a loss flag. A row is a whole conversation; one longer than PIECE_CHARS goes on in further rows, which
may begin anywhere between segments. Bodies are escaped so that no control string of the template occurs in them unescaped;
reading the text back finds the turns by their markers and ends alone, and unescaping gives them back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from inkwell.llm import common


@dataclass(frozen=True)
class Template:
    """Markers by role, the end of a turn, which roles' bodies bear loss, and the machine: role -> roles that may follow ("" begins)."""

    markers: tuple[tuple[str, str], ...] = (("system", "### System: "), ("user", "### User: "), ("assistant", "### Assistant: "))
    other: str = "### Other "
    other_end: str = ": "
    end: str = "</turn>\n"
    controls: tuple[str, ...] = ("###", "</turn>")
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: tuple[tuple[str, tuple[str, ...]], ...] = (("", ("system", "user")), ("system", ("user",)), ("user", ("assistant",)), ("assistant", ("user",)))
    _cache: dict = field(default_factory=dict, compare=False, repr=False)

    def _regex(self, what: str) -> re.Pattern:
        if what not in self._cache:
            control = "|".join(re.escape(x) for x in (self.escape, *self.controls))
            role = re.escape(self.other_end.strip())
            patterns = {
                "escape": f"({control})",
                "unescape": f"{re.escape(self.escape)}({control}|{role})",
                "role": f"({control}|{role})",
            }
            self._cache[what] = re.compile(patterns[what], re.DOTALL)
        return self._cache[what]

    def escaped(self, text: str) -> str:
        return self._regex("escape").sub(lambda m: self.escape + m[1], text)

    def unescaped(self, text: str) -> str:
        return self._regex("unescape").sub(lambda m: m[1], text)

    def marker(self, role: str) -> str:
        known = dict(self.markers)
        if role in known:
            return known[role]
        return self.other + self._regex("role").sub(lambda m: self.escape + m[1], role) + self.other_end

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss) of a turn, in order."""
        return [(self.marker(role), False), (self.escaped(text), role in self.loss_roles), (self.end, False)]

    def turn_end(self, text: str, start: int) -> int:
        """Where the turn that begins at start ends, its end included; -1 if the text has no end of it yet."""
        at = text.find(self.end, start)
        while at >= 0:
            bare = at
            while bare > start and text.startswith(self.escape, bare - len(self.escape)):
                bare -= len(self.escape)
            if (at - bare) // len(self.escape) % 2 == 0:
                return at + len(self.end)
            at = text.find(self.end, at + 1)
        return -1

    def parsed(self, formatted: str) -> tuple[str, str]:
        """Role and text of one formatted turn."""
        for role, marker in self.markers:
            if formatted.startswith(marker):
                return role, self.unescaped(formatted[len(marker) : len(formatted) - len(self.end)])
        at = len(self.other)
        while not formatted.startswith(self.other_end, at):
            at += 2 if formatted.startswith(self.escape, at) else 1
        body = formatted[at + len(self.other_end) : len(formatted) - len(self.end)]
        return self.unescaped(formatted[len(self.other) : at]), self.unescaped(body)


#: Characters after which a conversation goes on in a further row.
PIECE_CHARS = 1 << 16
SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
_PIECE = "piece_no bigint, last boolean, segments array<struct<text:string,loss:boolean>>, valid boolean"


def _schema(conv, ddl: str) -> StructType:
    return StructType([StructField("conv_id", conv), *StructType.fromDDL(ddl).fields])


def formatted(turns: DataFrame, template: Template | None = None, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, piece_no (from 0), last, segments (text and loss flag, in order), valid: the formatted conversations.

    The formatted text of a conversation is that of its segments, joined. Turns are ordered by `turn` (null first), ties by role
    and text; repeated rows are turns of their own. Null texts and roles are empty. Roles without a marker get a generic one
    with their name. valid (in the last row for all): the machine accepts the turns up to here; a turn that it doesn't accept is
    still formatted, so no row is lost, and the machine goes on from its role. A null conv_id is a conversation; it may have
    any type. A long text stays whole, as one segment. All turns of a conversation go to one task, in order. Columns besides
    the four are left out. Empty tables give no rows.
    """
    shape = template or Template()
    common.small_batches(turns.sparkSession)
    packed = common.Packed(turns)
    rows = packed.docs.select(packed.column(conv).alias("conv_id"), packed.column(turn).alias("t"), F.coalesce(packed.column(role), F.lit("")).alias("role"), F.coalesce(packed.column(text), F.lit("")).alias("text"))

    def format_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = dict(shape.follows)
        kind = None
        done: list[tuple] = []
        size = chars = 0
        begun, current, state, good, number = False, None, "", True, 0
        held: list[tuple[str, bool]] = []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            segments = pa.array([[{"text": t, "loss": x} for t, x in part] for part in columns[3]], SEGMENTS)
            out = [pa.array(columns[0], kind), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.bool_()), segments, pa.array(columns[4], pa.bool_())]
            done.clear()
            return pa.RecordBatch.from_arrays(out, names=["conv_id", "piece_no", "last", "segments", "valid"])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv_id, who, said in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if begun and conv_id != current:
                    done.append((current, number, True, held, good))
                    held, chars, state, good, number = [], 0, "", True, 0
                begun, current = True, conv_id
                good = good and who in allowed.get(state, ())
                state = who
                for segment in shape.segments(who, said):
                    if chars >= PIECE_CHARS:
                        done.append((current, number, False, held, good))
                        held, chars, number = [], 0, number + 1
                    held.append(segment)
                    chars += len(segment[0])
                    size += len(segment[0])
                if size >= 16 * PIECE_CHARS and done:
                    size = 0
                    yield flushed()
        if begun:
            done.append((current, number, True, held, good))
        if done:
            yield flushed()

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "t", "role", "text")
    return ordered.mapInArrow(format_turns, _schema(rows.schema["conv_id"].dataType, _PIECE))


_DIGEST = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean"


class _Reader:
    """Reads one conversation's pieces; holds the turn that isn't complete yet and running digests."""

    def __init__(self, shape: Template):
        self.shape, self.rest, self.n, self.chars, self.loss_chars = shape, "", 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, segments: list[dict]) -> None:
        text = "".join(x["text"] for x in segments)
        self.chars += len(text)
        self.rest += text
        start = 0
        while (end := self.shape.turn_end(self.rest, start)) >= 0:
            role, said = self.shape.parsed(self.rest[start:end])
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n, start = self.n + 1, end
        self.rest = self.rest[start:]
        for segment in segments:
            if segment["loss"]:
                bare = self.shape.unescaped(segment["text"])
                self.loss.update(bare.encode())
                self.loss_chars += len(bare)

    def result(self) -> tuple:
        if self.rest:
            raise ValueError("a formatted conversation ends within a turn")
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digests(output: DataFrame, template: Template | None = None) -> DataFrame:
    """Read formatted() back: for each conversation the number and digest of its turns, and characters and digest under the loss mask.

    Turns are parsed from the joined text, the loss mask is that of the segments. Digests grow turn by turn; no conversation is
    held as a whole. Conversations of one row, which is all but very long ones, are read where they lie; rows of the others
    are brought together, in order. A text that ends within a turn raises an error. Repeated rows of output aren't allowed; an
    empty table gives no rows.
    """
    shape = template or Template()
    common.small_batches(output.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(shape)
        for batch in batches:
            done: list[tuple] = []
            for conv_id, number, last, segments, valid in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece_no", "last", "segments", "valid")), strict=True):
                if number == 0:
                    reader = _Reader(shape)
                reader.read(segments)
                if last:
                    done.append((conv_id, *reader.result(), valid))
            if done:
                kinds = (batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*done, strict=True), kinds, strict=True)], names=["conv_id", *[x.split(" ")[0] for x in _DIGEST.split(", ")]])

    rows = output.select("conv_id", "piece_no", "last", "segments", "valid")
    schema = _schema(output.schema["conv_id"].dataType, _DIGEST)
    one = (F.col("piece_no") == 0) & F.col("last")
    long = rows.filter(~one).repartition("conv_id").sortWithinPartitions("conv_id", "piece_no")
    return rows.filter(one).mapInArrow(read, schema).unionByName(long.mapInArrow(read, schema))
