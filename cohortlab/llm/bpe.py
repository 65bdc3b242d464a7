"""Byte-level BPE encoding and decoding.

Pre-tokenisation needs no regular expression: every code point gets a class
(letter, number, other, white space with a look at its successor, apostrophe that
may open a contraction), every class is a transition function over eight states,
and composing functions is associative. Blocks of characters are composed for all
states at once, the block functions by doubling, and a second sweep gives the
state before each character; (state, class) tells where a piece starts. Pieces are
looked up in a bounded cache of merged ids. Byte offsets of the ids are kept and
place the bytes again on decoding.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import docs_of, release

# fixed values: classes of characters
LETTER, NUMBER, OTHER, SHORT_CONTRACTION, LONG_CONTRACTION, SPACE_INNER, BLANK_LAST, SPACE_LAST = range(8)
# fixed values: what the previous character was part of
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_BLANK, IN_SPACE, ONE_MORE, TWO_MORE = range(8)
# fixed values: contractions after an apostrophe, by length
CONTRACTIONS_1 = "stmd"
CONTRACTIONS_2 = ("re", "ve", "ll")

BLOCK = 64
CACHE_PIECES = 500_000     # about 100 MB
CACHE_BYTES = 128          # longer pieces are merged each time
_kinds: list[np.ndarray] = []


def code_point_kinds() -> np.ndarray:
    """For each code point: 0 letter, 1 number, 2 other, 3 white space."""
    if not _kinds:
        def kind(c: str) -> int:
            if c.isspace() and not "\x1c" <= c <= "\x1f":
                return 3
            return {"L": 0, "N": 1}.get(unicodedata.category(c)[0], 2)
        _kinds.append(np.fromiter((kind(chr(c)) for c in range(0x110000)), np.uint8, 0x110000))
    return _kinds[0]


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, piece starts here) by class * 8 + state; class + 8 is the first character of a text."""
    nxt, cut = np.zeros((16, 8), np.uint8), np.zeros((16, 8), bool)
    opens = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, SHORT_CONTRACTION: ONE_MORE,
             LONG_CONTRACTION: TWO_MORE, SPACE_INNER: IN_SPACE, BLANK_LAST: AFTER_BLANK, SPACE_LAST: FRESH}
    runs = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, SHORT_CONTRACTION: IN_OTHER,
            LONG_CONTRACTION: IN_OTHER}
    for c in range(8):
        for s in range(8):
            nxt[c, s], cut[c, s] = opens[c], True
            if s in (ONE_MORE, TWO_MORE):                        # inside a contraction
                nxt[c, s], cut[c, s] = (FRESH if s == ONE_MORE else ONE_MORE), False
            elif c in runs and s in (runs[c], AFTER_BLANK):      # goes on with a run, or joins its blank
                nxt[c, s], cut[c, s] = runs[c], False
            elif c == SPACE_INNER and s == IN_SPACE:
                cut[c, s] = False
        nxt[c + 8], cut[c + 8] = opens[c], True
    return nxt.ravel(), cut.ravel()


NEXT, CUT = _machine()


def classes(points: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Class of each character; ``first`` and ``end`` bound the non-empty texts."""
    kind = code_point_kinds()[points]
    cls = kind.copy()
    space = kind == 3
    follows = np.zeros(len(points), bool)           # a non-space character of the same text comes next
    follows[:-1] = ~space[1:]
    follows[end - 1] = False
    cls[space] = SPACE_INNER
    last = space & follows
    cls[last] = SPACE_LAST
    cls[last & (points == 32)] = BLANK_LAST
    at = np.flatnonzero(points == 39)
    if len(at):
        stop = end[np.searchsorted(end, at, "right")]
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        a = np.where(at + 1 < stop, padded[at + 1], 0)
        b = np.where(at + 2 < stop, padded[at + 2], 0)
        short = np.isin(a, [ord(c) for c in CONTRACTIONS_1])
        long = np.zeros(len(at), bool)
        for x, y in CONTRACTIONS_2:
            long |= (a == ord(x)) & (b == ord(y))
        cls[at[short]] = SHORT_CONTRACTION
        cls[at[long]] = LONG_CONTRACTION
    cls[first] += 8
    return cls


def states_before(cls: np.ndarray) -> np.ndarray:
    """State before each character, by an associative scan over transition functions."""
    n = len(cls)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, OTHER, np.uint8)
    padded[:n] = cls
    steps = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T).astype(np.intp) << 3
    f = np.repeat(np.arange(8, dtype=np.uint8)[:, None], blocks, axis=1)
    for j in range(BLOCK):                          # each block's function, all blocks at once
        f = NEXT[steps[j] + f]
    d = 1
    while d < blocks:                               # inclusive scan of the block functions by doubling
        f[:, d:] = np.take_along_axis(f[:, d:], f[:, :-d].astype(np.intp), axis=0)
        d *= 2
    state = np.empty((BLOCK, blocks), np.uint8)
    s = np.concatenate([[FRESH], f[FRESH, :-1]]).astype(np.uint8)
    for j in range(BLOCK):
        state[j] = s
        s = NEXT[steps[j] + s]
    return state.T.ravel()[:n]


def piece_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte positions where the pieces of a slice's texts start."""
    if not len(data):
        return np.zeros(0, np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    byte = np.flatnonzero((data & 0xC0) != 0x80)
    bound = np.searchsorted(byte, off)
    full = bound[1:] > bound[:-1]
    cls = classes(points, bound[:-1][full], bound[1:][full])
    return byte[CUT[(cls.astype(np.intp) << 3) + states_before(cls)]]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: join the adjacent pair of lowest rank, leftmost first, until none has one."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    if n <= 48:
        parts = [piece[i:i + 1] for i in range(n)]
        pair = [ranks.get(piece[i:i + 2], 1 << 30) for i in range(n - 1)]
        while pair:
            low = min(pair)
            if low == 1 << 30:
                break
            i = pair.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
        return [ranks[p] for p in parts]
    stop, before = list(range(1, n + 1)), list(range(-1, n - 1))     # linked parts: [i, stop[i])
    alive = bytearray(b"\x01") * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        m = stop[i]
        if not alive[i] or m >= n or stop[m] != e or not alive[m]:
            continue
        alive[m] = 0
        stop[i] = e
        if e < n:
            before[e] = i
            if (r := ranks.get(piece[i:stop[e]])) is not None:
                heapq.heappush(heap, (r, i, stop[e]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:e])) is not None:
            heapq.heappush(heap, (r, p, e))
    return [ranks[piece[i:stop[i]]] for i in range(n) if alive[i]]


class Cache(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers; emptied when full."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        ids = np.array(merged(piece, self.ranks), "<u4").tobytes()
        if len(piece) <= CACHE_BYTES:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


def encode_slice(data: np.ndarray, off: np.ndarray, cache) -> list[bytes]:
    """Packed ids of each text of a slice."""
    start = piece_starts(data, off)
    text = data.tobytes()
    ends = np.append(start[1:], len(data)).tolist()
    pieces = [text[a:b] for a, b in zip(start.tolist(), ends)]
    bound = np.searchsorted(start, off).tolist()
    return [b"".join(map(cache.__getitem__, pieces[a:b])) for a, b in zip(bound[:-1], bound[1:])]


class Decoder:
    """Bytes of every id in one array, placed by the ids' byte offsets."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        table = [b""] * len(self.size)
        for piece, i in ranks.items():
            table[i], self.size[i] = piece, len(piece)
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.at = np.concatenate([[0], np.cumsum(self.size)[:-1]])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, byte offset of each id and of the end)."""
        size = self.size[ids]
        offset = np.concatenate([[0], np.cumsum(size)])
        source = np.repeat(self.at[ids] - offset[:-1], size)
        source += np.arange(offset[-1])
        return self.flat[source], offset


_ready: dict[str, tuple[Cache, Decoder]] = {}


def codec(path: str) -> tuple[Cache, Decoder]:
    """One cache and decoder per Python worker and rank file."""
    if path not in _ready:
        ranks = read_ranks(path)
        _ready[path] = Cache(ranks), Decoder(ranks)
    return _ready[path]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, equal boolean"


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode each row of ``docs(doc_id, text)`` by the ranks at ``path``.

    A null text counts as empty: no ids, digests of the empty string. Null ids stay null,
    repeated rows each give a row, other columns are ignored, an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, decoder = codec(path)
        for batch in batches:
            keys = batch.column("doc_id").cast(pa.int64())
            for i, j, data, off in docs_of(batch):
                packed = encode_slice(data, off, cache)
                ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
                count = np.array([len(p) // 4 for p in packed], np.int64)
                back, offset = decoder.decode(ids)
                bound = offset[np.concatenate([[0], np.cumsum(count)])]
                text, back = memoryview(np.ascontiguousarray(data)), memoryview(back)
                spans = [(back[a:b], text[c:d]) for a, b, c, d in zip(
                    bound[:-1].tolist(), bound[1:].tolist(), off[:-1].tolist(), off[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(i, j - i), pa.array(count),
                     pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                     pa.array([hashlib.sha256(b).hexdigest() for b, _ in spans], pa.string()),
                     pa.array(np.diff(bound)), pa.array([b == t for b, t in spans], pa.bool_())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "equal"])
        cache.clear()        # most pieces of the next task are new anyway, and workers live on
        release()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
