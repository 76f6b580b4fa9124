"""Words of Arrow text columns as numpy arrays: one pass over the UTF-8 bytes, no Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18

#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: digits, letters, all beyond ASCII.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x30:0x3A] = LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = True
LETTERS[0x80:] = True
#: Bytes of words [^\x20\x09-\x0D]+.
VISIBLE = np.ones(256, dtype=bool)
VISIBLE[0x20] = False
VISIBLE[0x09:0x0E] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_RANDOM = np.random.Generator(np.random.PCG64(20260101))
#: A 64-bit value for each byte, after lower-casing.
_VALUE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)[LOWER]
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWER = np.ones(BLOCK, dtype=np.uint64)
np.multiply.accumulate(np.full(BLOCK - 1, _ODD, dtype=np.uint64), out=_POWER[1:])
_INVERSE_ODD = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_INVERSE = np.ones(BLOCK, dtype=np.uint64)
np.multiply.accumulate(np.full(BLOCK - 1, _INVERSE_ODD, dtype=np.uint64), out=_INVERSE[1:])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty) and the offsets of the texts in them."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: all bits of the result depend on all bits of x."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA24BAED4963EE407)
    x ^= x >> np.uint64(32)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values, sorted."""
    x = np.sort(x)
    return x[heads(x)]


def heads(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it."""
    out = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and for each text the number of its first word (one entry more than texts)."""
    inside = np.empty(len(data) + 1, dtype=bool)
    inside[-1] = False
    np.take(table, data, out=inside[:-1])
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    first[cut] = inside[cut]
    last = np.empty_like(inside)  # last[i]: byte i is the last one of a word
    last[:-1] = inside[:-1] & ~inside[1:]
    last[-1] = False
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, lower-cased (A-Z), with its length mixed in; equal words are equal everywhere."""
    out = np.empty(len(starts), dtype=np.uint64)
    k = 0
    while k < len(starts):
        low = starts[k]
        stop = max(k + 1, int(np.searchsorted(ends, low + BLOCK - 1, side="right")))
        if ends[k] - low > BLOCK - 1:
            out[k] = _long_hash(data[low : ends[k]])
            k += 1
            continue
        high = ends[stop - 1]
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(_VALUE[data[low:high]] * _POWER[: high - low], out=sums[1:])
        s, e = starts[k:stop] - low, ends[k:stop] - low
        out[k:stop] = (sums[e] - sums[s]) * _INVERSE[s]
        k = stop
    out += (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed(out)


def _long_hash(word: np.ndarray) -> np.uint64:
    """The same polynomial for a word longer than a block."""
    total, scale = 0, 1
    for at in range(0, len(word), BLOCK):
        part = word[at : at + BLOCK]
        total = (total + scale * int(np.sum(_VALUE[part] * _POWER[: len(part)], dtype=np.uint64))) % (1 << 64)
        scale = scale * pow(int(_ODD), BLOCK, 1 << 64) % (1 << 64)
    return np.uint64(total)


def hashed_words(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and for each text the number of its first word."""
    data, offsets = text_bytes(texts)
    starts, ends, first = word_spans(data, offsets, table)
    return word_hashes(data, starts, ends), first
