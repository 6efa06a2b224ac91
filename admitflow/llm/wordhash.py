"""Words of an Arrow text column as numpy arrays: positions, documents, hashes.

The separators of every word rule used here are ASCII, so words can be found
on the UTF-8 bytes of a whole column at once. Nulls and empty texts have no
words. Texts are never cut; callers bound memory by taking slices of whole
rows (``row_slices``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)
_GOLD = 0x9E3779B97F4A7C15
LONG_WORD = 512  # bytes; longer words are hashed one by one


def word_table(separators: str) -> np.ndarray:
    """256 flags: 1 where a byte belongs to a word; ``separators`` are ASCII."""
    table = np.ones(256, dtype=np.uint8)
    table[np.frombuffer(separators.encode("ascii"), dtype=np.uint8)] = 0
    return table


#: words ``[^\x20\x09-\x0D]+``
SPACED = word_table("\x20\x09\x0a\x0b\x0c\x0d")
#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``
ALNUM = word_table("".join(chr(c) for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122)))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place)."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def constants(n: int, lane: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers of one hash lane."""
    k = np.arange(1, n + 1, dtype=U64) + U64(1000003 * (lane + 1))
    return mix(k * U64(_GOLD)) | U64(1)


@dataclass
class Words:
    data: np.ndarray    # bytes of the rows (lower-cased on demand)
    start: np.ndarray   # first byte of each word
    end: np.ndarray     # byte behind each word
    row: np.ndarray     # row of each word
    first: np.ndarray   # first word of each row, and the number of words

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1 joined by one space."""
        d = self.data
        return b" ".join(d[s:e].tobytes() for s, e in zip(self.start[i:j], self.end[i:j], strict=True))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null has no bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def row_slices(offsets: np.ndarray, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about ``limit`` bytes (one row at least)."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def split_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED,
                lower: bool = False) -> Words:
    """Words of all rows; no word crosses a row."""
    n = len(data)
    if lower:
        data = _LOWER[data]
    inside = table[data].astype(bool)
    prev = np.empty(n, dtype=bool)
    follow = np.empty(n, dtype=bool)
    prev[1:], follow[:-1] = inside[:-1], inside[1:]
    if n:
        filled = offsets[:-1][np.diff(offsets) > 0]
        prev[filled] = False
        follow[offsets[1:][np.diff(offsets) > 0] - 1] = False
    start = np.flatnonzero(inside & ~prev)
    end = np.flatnonzero(inside & ~follow) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, start, end, row, first)


def hash_words(w: Words) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    size = (w.end - w.start).astype(np.int64)
    h = mix(size.astype(U64) * U64(_GOLD))
    if not len(size):
        return h
    padded = np.concatenate([w.data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    todo, lane = np.flatnonzero(size <= LONG_WORD), 0
    while len(todo):
        left = size[todo] - 8 * lane
        v = lanes[w.start[todo] + 8 * lane] & _MASK[np.minimum(left, 8)]
        v += U64((lane + 1) * _GOLD & (2**64 - 1))
        h[todo] = mix(h[todo] * U64(0xD6E8FEB86659FD93) ^ mix(v))
        todo, lane = todo[left > 8], lane + 1
    for i in np.flatnonzero(size > LONG_WORD):
        digest = hashlib.blake2b(w.data[w.start[i]:w.end[i]].tobytes(), digest_size=8).digest()
        h[i] = int.from_bytes(digest, "little")
    return h


def window_hashes(h: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """Hash of each run of ``n`` consecutive entries of ``h`` (rows ignored)."""
    if len(h) < n:
        return np.zeros(0, U64)
    c, m = constants(n, lane), len(h) - n + 1
    out = np.zeros(m, U64)
    for k in range(n):
        out += h[k:k + m] * c[k]
    return mix(out)


def windows_in_rows(w: Words, n: int) -> np.ndarray:
    """First words of the windows of ``n`` words that lie in one row."""
    if len(w) < n:
        return np.zeros(0, np.int64)
    return np.flatnonzero(w.row[: len(w) - n + 1] == w.row[n - 1:])


def join_words(w: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each row joined by one space, as a string column."""
    kept = np.flatnonzero(keep)
    size = w.end[kept] - w.start[kept] + 1
    ends_row = np.ones(len(kept), dtype=bool)
    ends_row[:-1] = w.row[kept[1:]] != w.row[kept[:-1]]
    size[ends_row] -= 1
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    at = np.arange(total) + np.repeat(w.start[kept] - (stop - size), size)
    out = np.append(w.data, np.uint8(0x20))[at]
    out[stop[~ends_row] - 1] = 0x20
    rows = len(w.first) - 1
    offsets = np.zeros(rows + 1, dtype=np.int64)
    np.add.at(offsets, w.row[kept] + 1, size)
    offsets = np.cumsum(offsets)
    return pa.LargeStringArray.from_buffers(rows, pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())
