"""Vectorised text primitives over Arrow string columns.

Texts of an Arrow batch are handled as one byte array with document offsets, a
bounded slice at a time (a slice holds whole documents, so one very long text is
its own slice). Strings are compared by 64-bit hashes taken from prefix sums:
``hash(s, e) = (P[e] - P[s]) * r**-s`` modulo 2**64, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U = np.uint64
_R = U(0x9E3779B97F4A7C15)                       # odd, so it has an inverse modulo 2**64
_R_INV = U(pow(int(_R), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_STEP = np.random.default_rng(20240301).integers(1, 1 << 63, 64, dtype=np.uint64) | U(1)
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def byte_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    off = np.frombuffer(col.buffers()[1], kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0]:off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes, at least one document each."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i for i < n; kept between calls unless a very long text asks for many."""
    if len(_powers.get("up", ())) >= n:
        return _powers["up"], _powers["down"]
    made = {}
    for name, base in (("up", _R), ("down", _R_INV)):
        p = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        p[0] = 1
        made[name] = np.multiply.accumulate(p, out=p)
    if n <= 4 * SLICE_BYTES:
        _powers.update(made)
    return made["up"], made["down"]


class Hashes:
    """Prefix sums of one byte array; hash of any range in O(1)."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:len(data)], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(np.uint64))


class Words:
    """Words of the documents of one slice: maximal runs of bytes outside ``breaks``."""

    def __init__(self, data: np.ndarray, off: np.ndarray, breaks: np.ndarray = SPACE):
        inside = ~breaks[data]
        st, en = inside.copy(), inside.copy()
        st[1:] &= ~inside[:-1]
        en[:-1] &= ~inside[1:]
        full = off[1:] > off[:-1]
        first, last = off[:-1][full], off[1:][full] - 1
        st[first] = inside[first]
        en[last] = inside[last]
        self.inside = inside
        self.start = np.flatnonzero(st)
        self.end = np.flatnonzero(en) + 1
        self.first = np.searchsorted(self.start, off)      # document -> its first word
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(off) - 1), self.count)

    def grams(self, word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every window of ``k`` words inside one document."""
        n = len(word) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1:])
        h = np.full(len(at), U(k))
        for j in range(k):
            h += word[at + j] * _STEP[j]
        return at, mix(h)


def per_doc(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many bytes of each document the mask marks."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def release() -> None:
    """Give back what Arrow keeps of freed batches: Python workers live on after a task."""
    pa.default_memory_pool().release_unused()


def docs_of(batch: pa.RecordBatch, text: str = "text"):
    """(row range, bytes, offsets) for each slice of whole documents of a batch."""
    data, off = byte_view(batch.column(batch.schema.get_field_index(text)))
    for i, j in slices(off):
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]
