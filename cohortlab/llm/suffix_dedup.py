"""Removal of repeated 100-byte strings by a distributed merge sort of suffixes.

Every window of 100 bytes has an anchor: its 32-byte string of smallest hash. The
windows with one anchor are adjacent and form a unit, so equal windows lie in units
whose anchors agree and whose suffixes from the anchor on share 32 bytes at least.
Sorting the units' suffixes brings them together:

1. anchors whose string occurs once in the corpus are dropped (sorted hash blocks);
2. each task sorts the suffixes of its remaining units, collapses equal ones to the
   earliest, cuts the run at common splitters and front-codes the parts;
3. the parts of one range are merged by a loser tree that carries the known common
   prefixes along and compares characters only behind them;
4. neighbours in the merged order with 32 common bytes are one family: equal units
   repeat the earliest one, in families with several contexts the windows are
   compared one by one.

Equal texts are one text from the start, so copies cost one row each. No family is
ever gathered beyond its distinct contexts in each run.

Anchors found more often than a fixed number take another way, since the units at both
ends of a shared passage have a context of their own in every text. Each task compares
their windows by hash and sends on the earliest of each; these are dealt out by window
hash, so a task meets a window at most once for each block sent.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Hashes, U, docs_of, mix, release
from .tables import free_name, stored

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1            # anchors a window can choose from
CHUNK = 1 << 23                     # bytes looked at at once; positions in it fit the low bits
LOW = U((1 << 24) - 1)
PART_BYTES = 16 << 20               # text per block of anchor hashes
RANGE_BYTES = 4 << 20               # text per range of suffixes
SAMPLE_BYTES = 1 << 27              # about so much text is looked at for the splitters
RUN_BYTES = 8 << 20                 # text per sorted run
SPLITTERS = 20_000                  # most sampled suffixes that the splitters come from
FAMILY = 5_000                      # an anchor counted more often than this has its windows dealt out by hash
COUNTED_FROM = 4                    # a task reports anchors that it holds this often
COUNTED_AT_ONCE = 1 << 22           # anchors a task holds to count them
WINDOWS_HELD = 1 << 20              # windows a task compares before it sends them on
WINDOW_BYTES = 16 << 20             # windows of a part, at 24 bytes each


def units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, hash of the anchor's string) of the texts of a slice."""
    n = len(data)
    valid = np.zeros(n + 1, np.int32)
    has = np.diff(off) >= LENGTH
    np.add.at(valid, off[:-1][has], 1)
    np.add.at(valid, off[1:][has] - LENGTH + 1, -1)
    valid = np.cumsum(valid[:n]) > 0
    out = []
    for c in range(0, max(n - LENGTH + 1, 0), CHUNK):
        stop = min(c + CHUNK, n - LENGTH + 1)                 # windows [c, stop)
        part = data[c:stop + LENGTH - 1]
        h = Hashes(part)
        gram = mix((h.sums[GRAM:] - h.sums[:-GRAM]) * h.down[:len(part) - GRAM + 1])
        least = (gram & ~LOW) | np.arange(len(gram), dtype=np.uint64)
        width = 1
        while width * 2 <= SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = SPAN - width
        if rest:
            least = np.minimum(least[:-rest], least[rest:])
        s = np.flatnonzero(valid[c:stop])
        if not len(s):
            continue
        p = (least[s] & LOW).astype(np.int64)
        new = np.ones(len(s), bool)
        new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(s)) - 1
        out.append((p[first] + c, s[first] + c, s[last] + c, gram[p[first]]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*out))


def frequent_anchors(rows: DataFrame) -> tuple[np.ndarray, int]:
    """(sorted hashes of the anchors counted more than FAMILY times, how often they were counted together).

    Tasks report what they hold COUNTED_FROM times, so an anchor left out has at most FAMILY
    places and a few more for each task. The table has one entry for FAMILY anchors at most.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= COUNTED_FROM
            return pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(n[often])], ["h", "n"])

        for batch in batches:
            for _, _, data, off in docs_of(batch):
                held.append(units(data, off)[3])
                size += len(held[-1])
                if size >= COUNTED_AT_ONCE:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()
        release()

    found = (rows.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
             .filter(F.col("n") > FAMILY).toPandas())
    return np.sort(found["h"].to_numpy(np.int64).view(np.uint64)), int(found["n"].sum())


def holds(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def anchors(parts: int, frequent: np.ndarray):
    """Blocks (part, hashes, places): 48 bits of each anchor hash, 40 bits of the text key and 24 of the position.

    Frequent anchors need no search; a block without hashes has the keys of texts that hold some.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("k").to_numpy()
            for i, j, data, off in docs_of(batch):
                p, _, _, h = units(data, off)
                often = holds(frequent, h)
                doc = np.searchsorted(off, p, "right") - 1
                if often.any():
                    own = keys[i:j][np.unique(doc[often])]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(own % parts), pa.array([b""] * len(own), pa.binary()),
                        pa.array([x.tobytes() for x in own.astype(np.uint64)], pa.binary())], ["part", "hashes", "places"])
                    p, h, doc = p[~often], h[~often], doc[~often]
                if not len(p):
                    continue
                place = (keys[i:j][doc].astype(np.uint64) << U(24)) | ((p - off[doc]).astype(np.uint64) & LOW)
                part = (h % U(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                bound = np.searchsorted(part[order], np.arange(parts + 1))
                short = np.ascontiguousarray(h[order]).view(np.uint8).reshape(-1, 8)[:, 2:]
                place = place[order]
                used = np.flatnonzero(np.diff(bound))
                yield pa.RecordBatch.from_arrays([
                    pa.array(used), pa.array([short[bound[u]:bound[u + 1]].tobytes() for u in used], pa.binary()),
                    pa.array([place[bound[u]:bound[u + 1]].tobytes() for u in used], pa.binary())],
                    ["part", "hashes", "places"])

    return run


def repeated(blocks: pa.Table) -> pa.Table:
    """(k, at) of anchors whose string is found at two places at least; -1 in texts with frequent anchors."""
    bare = pc.equal(pc.binary_length(blocks.column("hashes")), 0)
    marked = np.frombuffer(b"".join(blocks.filter(bare).column("places").to_pylist()), np.uint64)
    blocks = blocks.filter(pc.invert(bare))
    short = np.frombuffer(b"".join(blocks.column("hashes").to_pylist()), np.uint8).reshape(-1, 6)
    full = np.zeros((len(short), 8), np.uint8)
    full[:, :6] = short
    h = full.view(np.uint64).ravel()
    place = np.frombuffer(b"".join(blocks.column("places").to_pylist()), np.uint64)
    order = np.lexsort((place, h))
    h, place = h[order], place[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (place[1:] != place[:-1])      # equal texts count once
    h, place = h[fresh], place[fresh]
    same = h[1:] == h[:-1]
    many = np.zeros(len(h), bool)
    many[1:] |= same
    many[:-1] |= same
    found = place[many]
    k, at = np.append(found >> U(24), marked), np.append((found & LOW).astype(np.int32), np.full(len(marked), -1, np.int32))
    return pa.Table.from_arrays([pa.array(k.view(np.int64)), pa.array(at.astype(np.int32))], ["k", "at"])


def suffixes(text: bytes, p: list[int], lo: list[int], hi: list[int]) -> list[bytes]:
    """From the anchor to the end of its last window, then what lies before it, reversed, then its length."""
    return [text[a:c + LENGTH] + text[b:a][::-1] + bytes((a - b,)) for a, b, c in zip(p, lo, hi)]


def windows(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor's string, hash, start) of every window of units in ascending order."""
    n = hi - lo + 1
    start = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
    h = np.zeros(len(start), np.uint64)
    for c in range(0, len(data) if len(start) else 0, CHUNK):
        a, b = np.searchsorted(start, [c, c + CHUNK])
        if a < b:
            h[a:b] = Hashes(data[c:c + CHUNK + LENGTH]).of(start[a:b] - c, start[a:b] - c + LENGTH)
    return np.repeat(anchor, n), h, start


def texts_with_units(batch: pa.RecordBatch, frequent: np.ndarray):
    """(doc_id, key, text, anchors, first windows, last windows, windows of frequent anchors) of each text's flagged units."""
    ids, keys, at = batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), batch.column("at")
    for i, j, data, off in docs_of(batch):
        p, lo, hi, h = units(data, off)
        often = holds(frequent, h)
        family, window, place = windows(data, lo[often], hi[often], h[often])
        inside = np.searchsorted(place, off)
        bound = np.searchsorted(p, off)
        text = data.tobytes()
        for d in range(j - i):
            a, b, start = bound[d], bound[d + 1], int(off[d])
            own = p[a:b] - start
            x = slice(inside[d], inside[d + 1])
            flagged = ~often[a:b] & np.isin(own & int(LOW), at[i + d].values.to_numpy(zero_copy_only=False))
            yield (ids[i + d], keys[i + d], text[start:int(off[d + 1])],
                   own[flagged], lo[a:b][flagged] - start, hi[a:b][flagged] - start, (family[x], window[x], place[x] - start))


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    m = min(len(a), len(b))
    d = int.from_bytes(a[known:m], "big") ^ int.from_bytes(b[known:m], "big")
    return m - (d.bit_length() + 7) // 8


def front_code(rows: list[tuple], docs: list[tuple]) -> bytes:
    """One part of a run: common prefix lengths, remaining bytes, (text, position) of each suffix."""
    lcp, tails, before = [], [], b""
    for s, _, _ in rows:
        c = common(before, s, 0)
        lcp.append(c)
        tails.append(s[c:])
        before = s
    used = sorted({d for _, d, _ in rows})
    renamed = {d: x for x, d in enumerate(used)}
    ids = [docs[d][0] for d in used]
    head = np.array([len(rows), len(used)], np.uint32).tobytes()
    body = [head, np.array(lcp, np.uint16).tobytes(), np.array([len(t) for t in tails], np.uint16).tobytes(),
            np.array([renamed[d] for _, d, _ in rows], np.uint32).tobytes(), np.array([p for _, _, p in rows], np.uint32).tobytes(),
            np.array([i is not None for i in ids], np.uint8).tobytes(), np.array([i or 0 for i in ids], np.int64).tobytes(),
            b"".join(docs[d][1] for d in used), *tails]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(body))


def decode(block: bytes) -> tuple[list[bytes], list[int], list[int], list[int], list[tuple]]:
    """(suffixes, common prefix lengths, text numbers, positions, [(id order, key)])."""
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, m = np.frombuffer(raw, np.uint32, 2).tolist()
    at = 8

    def take(kind, count):
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out.tolist()

    lcp, size, doc, pos = take(np.uint16, n), take(np.uint16, n), take(np.uint32, n), take(np.uint32, n)
    known, ids = take(np.uint8, m), take(np.int64, m)
    docs = [((k, i), raw[at + 16 * x:at + 16 * x + 16]) for x, (k, i) in enumerate(zip(known, ids))]
    at += 16 * m
    out, before = [], b""
    for c, t in zip(lcp, size):
        before = before[:c] + raw[at:at + t]
        at += t
        out.append(before)
    return out, lcp, doc, pos, docs


def merge(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, index, common prefix with the suffix before) in sorted order, by a loser tree.

    Each player carries its common prefix with the last winner. The longer one is smaller;
    only equal ones need characters, and those behind the known prefix only. The loser keeps
    its common prefix with the winner.
    """
    k = len(runs)
    size = 1
    while size < k:
        size *= 2
    at, lcp = [0] * size, [0] * size
    strings = [r[0] for r in runs] + [[] for _ in range(size - k)]
    prefixes = [r[1] for r in runs] + [[] for _ in range(size - k)]
    head = [s[0] if s else None for s in strings]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = head[a], head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        c = common(x, y, lcp[a])
        if x[c:c + 1] <= y[c:c + 1]:
            lcp[b] = c
            return a, b
        lcp[a] = c
        return b, a

    tree, level = [0] * size, list(range(size))
    node = size // 2
    while len(level) > 1:
        winners = []
        for x in range(0, len(level), 2):
            w, tree[node + x // 2] = play(level[x], level[x + 1])
            winners.append(w)
        level, node = winners, node // 2
    winner = level[0]
    while head[winner] is not None:
        yield winner, at[winner], lcp[winner]
        at[winner] += 1
        i = at[winner]
        if i < len(strings[winner]):
            head[winner], lcp[winner] = strings[winner][i], prefixes[winner][i]
        else:
            head[winner] = None
        node = (winner + size) // 2
        while node >= 1:
            winner, tree[node] = play(winner, tree[node])
            node //= 2


def pack_windows(family: np.ndarray, window: np.ndarray, doc: np.ndarray, pos: np.ndarray, docs: list[tuple]) -> bytes:
    used, renamed = np.unique(doc, return_inverse=True)
    ids = [docs[d][0] for d in used]
    body = [np.array([len(doc), len(used)], np.uint32).tobytes(), family.tobytes(), window.tobytes(),
            renamed.astype(np.uint32).tobytes(), pos.astype(np.uint32).tobytes(), np.array([i is not None for i in ids], np.uint8).tobytes(),
            np.array([i or 0 for i in ids], np.int64).tobytes(), b"".join(docs[d][1] for d in used)]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(body))


def unpack_windows(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
    """(families, windows, text numbers, positions, [(id order, key)])."""
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, m = np.frombuffer(raw, np.uint32, 2).tolist()
    at, out = 8, []
    for kind, count in ((np.uint64, n), (np.uint64, n), (np.uint32, n), (np.uint32, n), (np.uint8, m), (np.int64, m)):
        out.append(np.frombuffer(raw, kind, count, at))
        at += out[-1].nbytes
    names = [((k, i), raw[at + 16 * x:at + 16 * x + 16]) for x, (k, i) in enumerate(zip(out[4].tolist(), out[5].tolist()))]
    return *out[:4], names


def earliest(family: np.ndarray, window: np.ndarray, rank: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which windows are the first of their kind in the order of ``rank`` and ``pos``."""
    order = np.lexsort((pos, rank, window, family))
    f, w = family[order], window[order]
    out = np.ones(len(order), bool)
    out[order[1:]] = (f[1:] != f[:-1]) | (w[1:] != w[:-1])
    return out


def window_spans(doc: np.ndarray, pos: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(text, spans) of repeated windows, those at adjacent places as one span."""
    if not len(doc):
        return
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order].astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    pairs = np.stack([pos[first], pos[last] + LENGTH], 1).astype(np.int32)
    owner = doc[first]
    bound = np.append(np.flatnonzero(np.append(True, owner[1:] != owner[:-1])), len(owner))
    for a, b in zip(bound[:-1], bound[1:]):
        yield int(owner[a]), pairs[a:b].tobytes()


def first_windows(rows: pa.Table) -> pa.Table:
    """Compare one part of the windows of frequent anchors: (key, spans) of those that repeat earlier ones."""
    blocks = [unpack_windows(b) for b in rows.column("blob").to_pylist()]
    names = sorted({name for *_, own in blocks for name in own})
    rank = {name: r for r, name in enumerate(names)}
    family, window, pos = (np.concatenate([b[x] for b in blocks]) for x in (0, 1, 3))
    doc = np.concatenate([np.array([rank[name] for name in b[4]], np.int64)[b[2]] for b in blocks])
    again = ~earliest(family, window, doc, pos)
    found = list(window_spans(doc[again], pos[again]))
    return pa.Table.from_arrays([pa.array([names[d][1] for d, _ in found], pa.binary()), pa.array([x for _, x in found], pa.binary())],
                                ["key", "spans"])


def runs_of(splitters: list[bytes], frequent: np.ndarray, window_parts: int):
    """Rows (part, key, blob): front-coded parts of sorted runs, and spans of units collapsed on the way (key set).

    Parts behind those of the suffixes have the windows of frequent anchors, each once for a block.
    """
    ranges = len(splitters) + 1

    def compared(held: list[tuple], docs: list[tuple]) -> pa.RecordBatch:
        order = sorted(range(len(docs)), key=lambda d: ((docs[d][0] is not None, docs[d][0] or 0), docs[d][1]))
        rank = np.empty(len(docs), np.int64)
        rank[order] = np.arange(len(docs))
        family, window, pos = (np.concatenate([h[x] for h in held]) for x in (1, 2, 3))
        doc = np.repeat([h[0] for h in held], [len(h[1]) for h in held])
        first = earliest(family, window, rank[doc], pos)
        out = [(docs[d][1][0] % ranges, docs[d][1], x) for d, x in window_spans(doc[~first], pos[~first])]
        family, window, doc, pos = (x[first] for x in (family, window, doc, pos))
        part = (window % U(window_parts)).astype(np.int64)
        by_part = np.argsort(part, kind="stable")
        bound = np.searchsorted(part[by_part], np.arange(window_parts + 1))
        for u in np.flatnonzero(np.diff(bound)).tolist():
            own = by_part[bound[u]:bound[u + 1]]
            out.append((ranges + u, None, pack_windows(family[own], window[own], doc[own], pos[own], docs)))
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())],
                                          ["part", "key", "blob"])

    def flush(rows: list[tuple], docs: list[tuple]) -> pa.RecordBatch:
        order = sorted(range(len(docs)), key=lambda d: ((docs[d][0] is not None, docs[d][0] or 0), docs[d][1]))
        rank = {d: r for r, d in enumerate(order)}
        rows.sort(key=lambda r: (r[0], rank[r[1]], r[2]))
        parts: dict[int, list[tuple]] = {}
        spans: dict[int, list[int]] = {}
        before = None
        for row in rows:
            s, d, p = row
            if s == before:
                left = s[-1]
                spans.setdefault(d, []).extend((p - left, p + len(s) - 1 - left))
            else:
                parts.setdefault(bisect_right(splitters, s[:GRAM]), []).append(row)
                before = s
        out = [(part, None, front_code(own, docs)) for part, own in parts.items()]
        out += [(docs[d][1][0] % (len(splitters) + 1), docs[d][1], np.array(x, np.int32).tobytes()) for d, x in spans.items()]
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())],
                                          ["part", "key", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, docs, held, many, n_many = [], [], 0, [], 0
        for batch in batches:
            for doc_id, key, text, p, lo, hi, own in texts_with_units(batch, frequent):
                p = p.tolist()
                if len(own[0]):
                    many.append((len(docs), *own))
                    n_many += len(own[0])
                rows += zip(suffixes(text, p, lo.tolist(), hi.tolist()), [len(docs)] * len(p), p)
                docs.append((doc_id, key))
                held += len(text)
                if many and (n_many >= WINDOWS_HELD or held >= RUN_BYTES):
                    yield compared(many, docs)
                    many, n_many = [], 0
                if held >= RUN_BYTES:
                    if rows:
                        yield flush(rows, docs)
                    rows, docs, held = [], [], 0
        if many:
            yield compared(many, docs)
        if rows:
            yield flush(rows, docs)
        release()

    return run


def repeated_windows(contexts: list[tuple]) -> Iterator[tuple[int, int, int]]:
    """(text, start, end) of windows that an earlier context of their family holds too.

    ``contexts`` are (family, order, text number, position, suffix), one for each distinct unit.
    """
    contexts.sort(key=lambda c: c[1])
    plain = []
    for _, _, _, _, s in contexts:
        left = s[-1]
        plain.append(s[-1 - left:-1][::-1] + s[:len(s) - 1 - left])
    size = np.array([len(x) for x in plain])
    base = np.cumsum(size) - size
    n = size - LENGTH + 1
    owner = np.repeat(np.arange(len(plain)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = base[owner] + offset
    h = Hashes(np.frombuffer(b"".join(plain), np.uint8)).of(start, start + LENGTH)
    h = mix(h + np.array([c[0] for c in contexts], np.uint64)[owner] * U(0xD6E8FEB86659FD93))
    order = np.argsort(h, kind="stable")                        # earlier contexts stay in front
    again = np.zeros(len(h), bool)
    again[order[1:]] = h[order[1:]] == h[order[:-1]]
    at = np.flatnonzero(again)
    if not len(at):
        return
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
    first = at[new]
    last = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1]
    for a, b in zip(first.tolist(), last.tolist()):
        _, _, doc, p, s = contexts[owner[a]]
        begin = p - s[-1]
        yield doc, begin + int(offset[a]), begin + int(offset[b]) + LENGTH


BATCH_CONTEXTS = 20_000


def merged_spans(rows: pa.Table) -> pa.Table:
    """Merge one range of suffixes: (key, spans) of bytes that repeat earlier ones."""
    spans: dict[bytes, list[int]] = {}
    runs, payload = [], []
    names: list[tuple] = []
    for key, blob in zip(rows.column("key").to_pylist(), rows.column("blob").to_pylist()):
        if key is not None:
            spans.setdefault(key, []).extend(np.frombuffer(blob, np.int32).tolist())
            continue
        strings, lcp, doc, pos, docs = decode(blob)
        payload.append((len(names), doc, pos))
        names += docs
        runs.append((strings, lcp))
    rank = [0] * len(names)
    for r, d in enumerate(sorted(range(len(names)), key=names.__getitem__)):
        rank[d] = r

    def repeat(doc: int, start: int, end: int) -> None:
        spans.setdefault(names[doc][1], []).extend((start, end))

    pending: list[tuple] = []
    family: list[list[tuple]] = []           # contexts of the family, each its (order, doc, position)
    texts: list[bytes] = []

    def close(number: int) -> None:
        firsts = []
        for s, own in zip(texts, family):
            own.sort()
            left = s[-1]
            for _, doc, p in own[1:]:
                repeat(doc, p - left, p + len(s) - 1 - left)
            firsts.append((number, own[0][0], own[0][1], own[0][2], s))
        if len(firsts) > 1:
            pending.extend(firsts)
        if len(pending) >= BATCH_CONTEXTS:
            for doc, a, b in repeated_windows(pending):
                repeat(doc, a, b)
            pending.clear()

    number = 0
    for run, i, c in merge(runs):
        s = runs[run][0][i]
        base, doc, pos = payload[run]
        entry = ((rank[base + doc[i]], pos[i]), base + doc[i], pos[i])
        if texts and c >= GRAM:
            if c == len(s) == len(texts[-1]):
                family[-1].append(entry)
            else:
                texts.append(s)
                family.append([entry])
            continue
        if texts:
            close(number)
        number += 1
        texts, family = [s], [[entry]]
    if texts:
        close(number)
    if pending:
        for doc, a, b in repeated_windows(pending):
            repeat(doc, a, b)
    return pa.Table.from_arrays([pa.array(list(spans), pa.binary()),
                                 pa.array([np.array(x, np.int32).tobytes() for x in spans.values()], pa.binary())], ["key", "spans"])


def cut(as_text: bool):
    """(key, n_removed, n_spans, kept) of each text with its spans; as text, a character cut in two goes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, keys = batch.column("spans").to_pylist(), batch.column("key")
            for i, j, data, off in docs_of(batch):
                removed, runs, kept = [], [], []
                for d in range(j - i):
                    own = data[off[d]:off[d + 1]]
                    pairs = np.frombuffer(b"".join(spans[i + d]), np.int32).reshape(-1, 2)
                    mark = np.zeros(len(own) + 1, np.int64)
                    np.add.at(mark, pairs[:, 0], 1)
                    np.add.at(mark, pairs[:, 1], -1)
                    gone = np.cumsum(mark[:-1]) > 0
                    removed.append(int(gone.sum()))
                    runs.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                    left = own[~gone].tobytes()
                    kept.append(left.decode("utf-8", "ignore") if as_text else left)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(i, j - i), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                     pa.array(kept, pa.string() if as_text else pa.binary())], ["key", "n_removed", "n_spans", "kept"])
        release()

    return run


def merged(ranges: int):
    """Parts of suffixes are merged, those behind them hold windows."""
    def run(rows: pa.Table) -> pa.Table:
        return first_windows(rows) if rows.column("part")[0].as_py() >= ranges else merged_spans(rows)

    return run


def splitters_of(texts: DataFrame, parts: int, total: int, frequent: np.ndarray) -> list[bytes]:
    """Anchor strings that divide the flagged suffixes into ``parts`` ranges of about equal size.

    They come from a sample of the texts by key; they decide where a suffix is merged, not whether.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, text, p, *_ in texts_with_units(batch, frequent):
                some = p[::max(1, len(p) // 4)].tolist()
                yield pa.RecordBatch.from_arrays([pa.array([text[a:a + GRAM] for a in some], pa.binary())], ["s"])

    some = texts.filter(F.crc32("key") % max(1, total // SAMPLE_BYTES) == 0)
    rows = some.mapInArrow(run, "s binary").orderBy(F.xxhash64("s", F.rand(7))).limit(SPLITTERS).collect()
    sample = sorted(bytes(r.s) for r in rows)
    return sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key): key is the MD5 of the text, null counting as empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("key"))


def repeated_bytes(docs: DataFrame, as_text: bool = False) -> DataFrame:
    """(key, n_removed, n_spans, kept) of every distinct text that repeats an earlier one somewhere.

    The results are for the row of smallest id (null first) with the text.
    """
    spark = docs.sparkSession
    rows = keyed(docs)
    short = F.conv(F.substring(F.hex("key"), 1, 10), 16, 10).cast("long")       # 40 bits of the key
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART_BYTES + 1)
    frequent, places = frequent_anchors(rows)
    at = (rows.select(short.alias("k"), "text").mapInArrow(anchors(parts, frequent), "part long, hashes binary, places binary")
          .groupBy("part").applyInArrow(repeated, "k long, at int")
          .groupBy("k").agg(F.collect_list("at").alias("at")))
    keys = rows.select("key", short.alias("k")).distinct()
    flagged = keys.join(at, "k").select("key", "at")
    texts = rows.groupBy("key").agg(F.first("text").alias("text"), F.min(F.struct("doc_id")).alias("rep"))
    texts = stored(texts.join(flagged, "key").select("key", "text", F.col("rep.doc_id").alias("doc_id"), "at"), "suffix-texts")
    splitters = splitters_of(texts, max(parts, total // RANGE_BYTES), total, frequent)
    window_parts = 24 * SPAN * places // WINDOW_BYTES + 1
    spans = (texts.mapInArrow(runs_of(splitters, frequent, window_parts), "part int, key binary, blob binary")
             .groupBy("part").applyInArrow(merged(len(splitters) + 1), "key binary, spans binary")
             .groupBy("key").agg(F.collect_list("spans").alias("spans")))
    return (texts.select("key", "text").join(spans, "key").select("key", "text", "spans")
            .mapInArrow(cut(as_text), f"key binary, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}"))


EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of ``docs(doc_id, text)``.

    Null texts count as empty. Rows come in the order of their ids, null first, and rows
    sharing an id in the order of the MD5 of their texts; rows equal in both are one
    document. A later row with an earlier row's whole text loses all of it (from 100 bytes
    on). Other columns are ignored; an empty table gives no rows.
    """
    rows = keyed(docs).select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"),
                              F.sha2(F.col("text").cast("binary"), 256).alias("_sha"))
    first = rows.groupBy("key").agg(F.min(F.struct("doc_id")).alias("_first"))
    done = repeated_bytes(docs).select("key", "n_removed", "n_spans", F.sha2("kept", 256).alias("_kept"))
    all_ = rows.join(first.join(done, "key", "left"), "key")
    copy = ~F.col("doc_id").eqNullSafe(F.col("_first.doc_id"))
    gone = copy & (F.col("n_bytes") >= LENGTH)
    return all_.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).when(copy, 0).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).when(copy, 0).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(EMPTY_SHA)).when(copy, F.col("_sha")).otherwise(F.coalesce("_kept", "_sha")).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """All rows of ``docs`` with the repeated bytes cut out of ``text``, other columns as they were.

    ``n_chars``, where there is one, is counted anew for texts that changed. Null and empty texts stay
    as they are. The order of rows, also of null and repeated ids, is that of ``dedup``: of rows with the
    same whole text those with the smallest id keep it, later ones lose it from 100 bytes on. An empty
    table stays empty.
    """
    key, first, kept, new = (free_name(docs, c) for c in ("_key", "_first", "_kept", "_new"))
    digest = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    doc_id = F.col("doc_id").cast("long")
    rows = docs.withColumn(key, digest)
    owner = docs.select(doc_id.alias("doc_id"), digest.alias(key)).groupBy(key).agg(F.min(F.struct("doc_id")).alias(first))
    texts = repeated_bytes(docs, as_text=True).select(F.col("key").alias(key), F.col("kept").alias(kept))
    copy = ~doc_id.eqNullSafe(F.col(f"{first}.doc_id"))
    long = F.octet_length("text") >= LENGTH
    joined = rows.join(owner.join(texts, key, "left"), key).withColumn(
        new, F.when(copy & long, F.lit("")).when(copy, F.col("text")).otherwise(F.coalesce(F.col(kept), F.col("text"))))
    values = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        changed = ~F.col(new).eqNullSafe(F.col("text"))
        values["n_chars"] = F.when(changed, F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return joined.select(*[values.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
