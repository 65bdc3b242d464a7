"""Ids of all pieces of a slice at once: a hash table of pieces kept in numpy arrays.

A piece of at most 16 bytes is its own key (two 64-bit words and its length), so nothing
depends on a hash being free of collisions. Only pieces new to the table are encoded, each
once; the ids of all are then gathered by place. The table is bounded and starts anew when
full, so its memory does not grow with what a worker has seen.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np

from .arrays import U, mix

KEY_BYTES = 16
SLOTS = 1 << 20                       # 22 MB of keys and places
FULL = SLOTS // 2
LONG_PIECES, LONG_BYTES = 20_000, 64     # pieces over 16 bytes kept by the table, each at most so long
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

Encoder = Callable[[list[bytes]], Sequence[Sequence[int]]]


def keys_of(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second eight bytes of each piece, zeros behind its end."""
    padded = np.concatenate([data, np.zeros(KEY_BYTES, np.uint8)])
    word = np.ndarray((len(data) + 9,), "<u8", padded, 0, (1,))
    return word[start] & _MASK[np.minimum(size, 8)], word[start + 8 * (size > 8)] & _MASK[np.clip(size - 8, 0, 8)]


class PieceTable:
    def __init__(self, encode: Encoder, kind: str = "<u2"):
        self.encode, self.kind = encode, np.dtype(kind)
        self.clear()

    def clear(self) -> None:
        self.one, self.two = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.size = np.zeros(SLOTS, np.uint8)              # 0: free
        self.at, self.count = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.uint8)
        self.pool, self.end = np.zeros(1 << 20, self.kind), 0
        self.used = 0
        self.long: dict[bytes, np.ndarray] = {}

    def find(self, h, one, two, size) -> np.ndarray:
        """Slot of each key, -1 where it is not in the table."""
        slot = np.full(len(h), -1, np.int64)
        open_, place = np.arange(len(h)), (h & U(SLOTS - 1)).astype(np.int64)
        while len(open_):
            held = self.size[place]
            same = (held == size[open_]) & (self.one[place] == one[open_]) & (self.two[place] == two[open_])
            slot[open_[same]] = place[same]
            on = ~same & (held > 0)
            open_, place = open_[on], (place[on] + 1) & (SLOTS - 1)
        return slot

    def insert(self, h, one, two, size, ids: Sequence[Sequence[int]]) -> None:
        """Distinct new keys with their ids."""
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), self.kind, int(count.sum()))
        while self.end + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.end:self.end + len(flat)] = flat
        at = self.end + np.cumsum(count) - count
        self.end += len(flat)
        self.used += len(h)
        open_, place = np.arange(len(h)), (h & U(SLOTS - 1)).astype(np.int64)
        while len(open_):
            free = self.size[place] == 0
            won = np.zeros(len(open_), bool)
            won[np.unique(np.where(free, place, -1), return_index=True)[1]] = True     # one key a free slot
            won &= free
            p, k = place[won], open_[won]
            self.one[p], self.two[p], self.size[p], self.at[p], self.count[p] = one[k], two[k], size[k], at[k], count[k]
            open_, place = open_[~won], np.where(free, place, (place + 1) & (SLOTS - 1))[~won]

    def ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one behind the other, number of ids of each piece)."""
        if len(start) <= FULL:
            return self._ids(data, start, end)
        # no more pieces at a time than the table holds, however long a text is
        parts = [self._ids(data, start[a:a + FULL], end[a:a + FULL]) for a in range(0, len(start), FULL)]
        return np.concatenate([x for x, _ in parts]), np.concatenate([c for _, c in parts])

    def _ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = end - start
        short = np.flatnonzero((size <= KEY_BYTES) & (size > 0))
        begin, length = start[short], size[short]
        one, two = keys_of(data, begin, length)
        h = mix(one ^ mix(two + length.astype(np.uint64)))
        slot = self.find(h, one, two, length)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            text = data.tobytes()
            if self.used + len(missing) > FULL:
                self.clear()
                missing = np.arange(len(h))
            while len(missing):
                new = missing[np.unique(h[missing], return_index=True)[1]]      # keys of equal hash: one a turn
                self.insert(h[new], one[new], two[new], length[new], self.encode(
                    [text[b:b + n] for b, n in zip(begin[new].tolist(), length[new].tolist())]))
                slot[missing] = self.find(h[missing], one[missing], two[missing], length[missing])
                missing = missing[slot[missing] < 0]
        count = np.zeros(len(size), np.int64)
        at = np.zeros(len(size), np.int64)
        count[short], at[short] = self.count[slot], self.at[slot]
        pool = self.pool
        long = np.flatnonzero(size > KEY_BYTES)
        if len(long):
            text = data.tobytes()
            own = [text[a:b] for a, b in zip(start[long].tolist(), end[long].tolist())]
            new = list({p for p in own if p not in self.long})
            made = {p: np.array(x, self.kind) for p, x in zip(new, self.encode(new))} if new else {}
            got = [made[p] if p in made else self.long[p] for p in own]
            if len(self.long) > LONG_PIECES:
                self.long.clear()
            self.long.update((p, x) for p, x in made.items() if len(p) <= LONG_BYTES)
            count[long] = [len(x) for x in got]
            at[long] = self.end + np.cumsum(count[long]) - count[long]
            pool = np.concatenate([self.pool[:self.end], *got])
        total = np.cumsum(count)
        source = np.repeat(at - (total - count), count)
        source += np.arange(len(source))
        return pool[source], count
