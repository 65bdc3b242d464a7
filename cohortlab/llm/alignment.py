"""Alignment of two tokenizers' tokens by merging their byte ends.

Tokenizer A is a byte-level BPE file of the tokenizers library, B a sentencepiece model that
puts a space before the text; both cover the bytes of space + text. The ends of a slice's
tokens are two rising lists. Their merge is cut by binary searches along diagonals of the
merge path into pieces of equal work that know nothing of each other: all pieces advance one
step at a time side by side. Each step emits an overlap (A token, B token, end of the bytes
they share); a piece that ends between two equal ends is stitched to its successor. Overlaps
that end both of their tokens are links and close the groups.

Tokens that end together cover the same bytes as far as the shorter one reaches, so one's
bytes end with the other's: the id pairs that links can hold are a list fixed by the two
vocabularies. Counts of pairs are arrays over that list, whatever the size of the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import docs_of, per_doc, release
from .bpe import Decoder
from .piece_table import PieceTable
from .tables import stored
from .token_ids import slice_ids, vocabulary

STEPS = 64                    # merge steps of one piece
SPACE_MARK = "▁"
NEVER = np.iinfo(np.int64).max
_ready: dict[str, tuple] = {}


# ------------------------------------------------------------------ merge path

class Overlaps(NamedTuple):
    """One row per distinct end: the tokens that cover the bytes up to it, and whether it ends both."""

    a: np.ndarray
    b: np.ndarray
    end: np.ndarray
    closes: np.ndarray


def diagonals(a: np.ndarray, b: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of two rising lists stands after every ``steps`` steps, equal ends of A first."""
    total = len(a) + len(b)
    d = np.append(np.arange(0, total, steps), total)
    low, high = np.maximum(d - len(b), 0), np.minimum(d, len(a))
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        at = np.flatnonzero(open_)
        m = middle[at]
        before = a[m] <= b[d[at] - 1 - m]          # a[m] lies on the path before this diagonal
        low[at] = np.where(before, m + 1, low[at])
        high[at] = np.where(before, high[at], m)
    return low, d - low


def merge(a: np.ndarray, b: np.ndarray, steps: int = STEPS) -> Overlaps:
    """Overlaps of two lists of ends that rise strictly and have the same last end."""
    if not len(a):
        none = np.zeros(0, np.int64)
        return Overlaps(none, none, none, np.zeros(0, bool))
    i, j = diagonals(a, b, steps)
    i, j, i_end, j_end = i[:-1].copy(), j[:-1].copy(), i[1:], j[1:]
    ends_a, ends_b = np.append(a, NEVER), np.append(b, NEVER)
    shape = (steps, len(i))
    of_a, of_b, end = (np.zeros(shape, np.int64) for _ in range(3))
    both, live, from_b = (np.zeros(shape, bool) for _ in range(3))
    last = np.full(len(i), -1, np.int64)
    for k in range(steps):
        x = np.where(i < i_end, ends_a[i], NEVER)
        y = np.where(j < j_end, ends_b[j], NEVER)
        own = np.minimum(x, y)
        of_a[k], of_b[k], end[k] = i, j, own
        both[k] = (x == y) & (own < NEVER)
        live[k] = (own > last) & (own < NEVER)     # an end of B behind the equal one of A has no bytes left
        take_a = (x <= y) & (own < NEVER)
        take_b = ~take_a & (own < NEVER)
        from_b[k] = take_b
        i, j = i + take_a, j + take_b
        last = np.where(own < NEVER, own, last)
    # stitch: a piece whose first step is B's end equal to the last end of the piece before
    split = np.flatnonzero(from_b[0, 1:] & (end[0, 1:] == last[:-1]))
    live[0, split + 1] = False
    both[steps - 1, split] = True                  # only the last piece may be shorter
    keep = live.T.ravel()
    return Overlaps(*(m.T.ravel()[keep] for m in (of_a, of_b, end, both)))


# ------------------------------------------------------------------ the two tokenizers

def piece_bytes(model) -> list[bytes]:
    """Bytes of each id of a sentencepiece model: U+2581 as a space, <0xHH> as the byte HH."""
    return [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i)
            else model.id_to_piece(i).replace(SPACE_MARK, " ").encode() for i in range(model.get_piece_size())]


def chunk_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where a text starts and where spaces follow something else."""
    space = data == 32
    start = space.copy()
    start[1:] &= ~space[:-1]
    start[off[:-1][off[:-1] < off[1:]]] = True
    return np.flatnonzero(start)


class SecondTokenizer:
    """Ids of B, chunk by chunk where no piece of the model has a space behind other characters.

    A chunk is a run of spaces and what follows it. Without such pieces no merge crosses a
    chunk's start, so a chunk has the same ids in every text.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = piece_bytes(self.model)
        self.by_chunk = not any(" " in self.model.id_to_piece(i).replace(SPACE_MARK, " ").lstrip(" ")
                                for i in range(self.model.get_piece_size()))
        blank = self.model.piece_to_id(SPACE_MARK)
        self.by_chunk &= self.bytes[blank] == b" "

        def encode(chunks: list[bytes]) -> list[list[int]]:
            # the model adds the first space again; it adds none to nothing
            made = self.model.encode([c[1:].decode() for c in chunks], num_threads=1)
            return [ids or [blank] for ids in made]
        kind = "<u2" if len(self.bytes) <= 1 << 16 else "<u4"
        self.table = PieceTable(encode, kind)

    def slice_ids(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number per text) of space-led, non-empty texts."""
        if self.by_chunk:
            start = chunk_starts(data, off)
            ids, count = self.table.ids(data, start, np.append(start[1:], len(data)))
            bound = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(start, off)]
            return ids, np.diff(bound)
        text = data.tobytes()
        own = [self.model.encode(text[x + 1:y].decode(), num_threads=1) for x, y in zip(off[:-1].tolist(), off[1:].tolist())]
        return np.array([i for ids in own for i in ids], np.int64), np.array([len(ids) for ids in own], np.int64)


class Tables(NamedTuple):
    second: SecondTokenizer
    a: Decoder
    b: Decoder
    keys: np.ndarray              # id of A << 32 | id of B of every pair that can end together, rising


def decoder(pieces: list[bytes]) -> Decoder:
    out = object.__new__(Decoder)
    out.size = np.array([len(p) for p in pieces], np.int64)
    out.flat = np.frombuffer(b"".join(pieces), np.uint8)
    out.at = np.concatenate([[0], np.cumsum(out.size)[:-1]])
    return out


def pair_keys(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Pairs of which one's bytes end with the other's."""
    ids_a, ids_b = {}, {}
    for pieces, ids in ((a, ids_a), (b, ids_b)):
        for i, p in enumerate(pieces):
            if p:
                ids.setdefault(p, []).append(i)
    found = set()
    for p, own in ids_a.items():
        for k in range(len(p)):
            found.update(i << 32 | j for j in ids_b.get(p[k:], ()) for i in own)
    for p, own in ids_b.items():
        for k in range(1, len(p)):
            found.update(i << 32 | j for i in ids_a.get(p[k:], ()) for j in own)
    return np.array(sorted(found), np.int64)


def tables(a_path: str, b_path: str) -> Tables:
    """One set per Python worker and pair of files."""
    key = f"{a_path}\n{b_path}"
    if key not in _ready:
        second, first = SecondTokenizer(b_path), vocabulary(a_path)
        _ready[key] = Tables(second, decoder(first), decoder(second.bytes), pair_keys(first, second.bytes))
    return _ready[key]


# ------------------------------------------------------------------ slices

class Aligned(NamedTuple):
    """Tokens and overlaps of the texts of a slice; ``*_first`` give each text's share."""

    a: np.ndarray
    a_end: np.ndarray
    a_first: np.ndarray
    b: np.ndarray
    b_end: np.ndarray
    b_first: np.ndarray
    overlaps: Overlaps
    overlap_first: np.ndarray
    text_first: np.ndarray        # byte where each text's space + text starts


def starts(count: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(count)])


def align_slice(data: np.ndarray, off: np.ndarray, a_path: str, b_path: str) -> Aligned:
    """Texts that are empty or not spelled again by both token lists have no tokens."""
    t = tables(a_path, b_path)
    size = np.diff(off)
    led = np.insert(data, off[:-1][size > 0], 32)
    at = starts(size + (size > 0))
    ids, count = [], []
    spelled = size > 0
    for got, decode in ((slice_ids(led, at, a_path), t.a), (t.second.slice_ids(led, at), t.b)):
        own, n = got
        own = own.astype(np.int64)
        back, offset = decode.decode(own)
        bytes_of = np.diff(offset[starts(n)])
        fits = bytes_of == np.diff(at)
        if fits.all() and len(back) == len(led):
            spelled &= per_doc(back != led, at) == 0
        else:
            first = offset[starts(n)]
            spelled &= np.array([f and bool((back[x:x + m] == led[y:y + m]).all()) for f, x, y, m in zip(
                fits.tolist(), first.tolist(), at.tolist(), bytes_of.tolist())], bool)
        ids.append(own)
        count.append(n)
    for s in range(2):
        ids[s] = ids[s][np.repeat(spelled, count[s])]
        count[s] = np.where(spelled, count[s], 0)
    a_end, b_end = np.cumsum(t.a.size[ids[0]]), np.cumsum(t.b.size[ids[1]])
    over = merge(a_end, b_end)
    text = starts(np.where(spelled, np.diff(at), 0))
    return Aligned(ids[0], a_end, starts(count[0]), ids[1], b_end, starts(count[1]), over,
                   np.searchsorted(over.end, text, "right"), text)


def digits(top: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of every number below ``top``, from the left, and how many; room for a separator."""
    width = len(str(top - 1))
    n = np.arange(top)
    count = np.ones(top, np.int64)
    for k in range(1, width):
        count += n >= 10 ** k
    out = np.zeros((top, width + 1), np.uint8)
    for k in range(width):
        out[:, k] = 48 + n // 10 ** np.maximum(count - 1 - k, 0) % 10
    return out, count


_digits: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def group_texts(x: Aligned, top: int) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each text: A's and B's ids of each group."""
    if top not in _digits:
        _digits[top] = digits(top)
    table, width = _digits[top]
    over = x.overlaps
    ends = over.end[over.closes]
    a_group, b_group = np.searchsorted(ends, x.a_end), np.searchsorted(ends, x.b_end)
    a_before, b_before = np.searchsorted(a_group, np.arange(len(ends) + 1)), np.searchsorted(b_group, np.arange(len(ends) + 1))
    a_place = np.arange(len(x.a)) + b_before[a_group]             # behind the B tokens of earlier groups
    b_place = np.arange(len(x.b)) + a_before[b_group + 1]         # and behind the A tokens of their own
    n = len(x.a) + len(x.b)
    ids, mark = np.zeros(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[a_place], ids[b_place] = x.a, x.b
    mark[a_place[a_before[1:] - 1]] = ord("|")
    mark[b_place[b_before[1:] - 1]] = ord(";")
    first = x.a_first + x.b_first
    rows, size = table[ids], width[ids] + 1
    rows[np.arange(n), size - 1] = mark
    flat = rows[np.arange(rows.shape[1]) < size[:, None]].tobytes()
    cut = starts(size)[first].tolist()
    return [flat[p:max(q - 1, p)] for p, q in zip(cut[:-1], cut[1:])]


# ------------------------------------------------------------------ tables of documents

SPANS = ("doc_id long, a_ids array<long>, a_ends array<long>, b_ids array<long>, b_ends array<long>, "
         "overlap_a array<long>, overlap_b array<long>, overlap_ends array<long>, group_ends array<long>")


def lists(first: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, pa.int64()))


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: both token lists with their byte ends in space + text, the
    overlaps (numbers of an A and a B token and the byte their shared stretch ends at) and the group ends.

    Null and empty texts, and texts that a token list does not spell again, have empty lists.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("doc_id").cast(pa.int64())
            for i, j, data, off in docs_of(batch):
                x = align_slice(data, off, a_path, b_path)
                over = x.overlaps
                base_a, base_b = np.repeat(x.text_first[:-1], np.diff(x.a_first)), np.repeat(x.text_first[:-1], np.diff(x.b_first))
                per = np.diff(x.overlap_first)
                ends = over.end - np.repeat(x.text_first[:-1], per)
                groups = starts(over.closes)[x.overlap_first]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(i, j - i), lists(x.a_first, x.a), lists(x.a_first, x.a_end - base_a),
                     lists(x.b_first, x.b), lists(x.b_first, x.b_end - base_b),
                     lists(x.overlap_first, over.a - np.repeat(x.a_first[:-1], per)),
                     lists(x.overlap_first, over.b - np.repeat(x.b_first[:-1], per)), lists(x.overlap_first, ends),
                     lists(groups, ends[over.closes])],
                    ["doc_id", "a_ids", "a_ends", "b_ids", "b_ends", "overlap_a", "overlap_b", "overlap_ends", "group_ends"])
        release()

    return docs.select("doc_id", "text").mapInArrow(run, SPANS)


def linked(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, links): links as places in the list of possible pairs, 32-bit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables(a_path, b_path)
        top = max(len(t.a.size), len(t.b.size))
        for batch in batches:
            keys = batch.column("doc_id").cast(pa.int64())
            for i, j, data, off in docs_of(batch):
                x = align_slice(data, off, a_path, b_path)
                over = x.overlaps
                pair = x.a[over.a[over.closes]] << 32 | x.b[over.b[over.closes]]
                place = np.searchsorted(t.keys, pair).astype("<u4")
                packed, first = place.tobytes(), starts(over.closes)[x.overlap_first]
                texts = group_texts(x, top)
                n_a = np.diff(x.a_first)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(i, j - i), pa.array(n_a), pa.array(np.diff(x.b_first)), pa.array(np.diff(first)),
                     pa.array([hashlib.sha256(s).hexdigest() if n else "" for s, n in zip(texts, n_a.tolist())], pa.string()),
                     pa.array([packed[4 * p:4 * q] for p, q in zip(first[:-1].tolist(), first[1:].tolist())], pa.binary())],
                    ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])
        release()

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary")


def links_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(places, first link of each row)."""
    own = batch.column("links").to_pylist()
    return np.frombuffer(b"".join(own), "<u4").astype(np.int64), starts(np.array([len(x) // 4 for x in own], np.int64))


def pair_counts(rows: DataFrame, n_pairs: int) -> np.ndarray:
    """How often each possible pair is linked; summed in tasks, then by Spark, at most one row per pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs, np.int64)
        for batch in batches:
            place, _ = links_of(batch)
            total += np.bincount(place, minlength=n_pairs)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["pair", "n"])

    found = rows.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_pairs, np.int64)
    out[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return out


def best_of_b(counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether a pair's count is the highest among the pairs of its B id."""
    b = keys & 0xFFFFFFFF
    most = np.zeros(int(b.max(initial=0)) + 1, np.int64)
    np.maximum.at(most, b, counts)
    return counts == most[b]


SCHEMA = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
          "groups_sha256 string")


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Alignment figures of each row of ``docs(doc_id, text)`` and how common its links are in all rows.

    Null and empty texts, and texts whose tokens spell other bytes, have zeros and an empty
    ``groups_sha256``. Null ids stay null; repeated rows each give a row and each count; other
    columns are never read; an empty table gives no rows. Two passes: links are stored once,
    counted, and looked up. What the driver and every task hold of the counts is one number per
    pair that the vocabularies allow (about half a million for 50,000 and 32,000 entries).
    """
    rows = stored(linked(docs, a_path, b_path), "alignment-links", compression="zstd")
    keys = tables(a_path, b_path).keys
    counts = pair_counts(rows, len(keys))
    best = best_of_b(counts, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, first = links_of(batch)
            weight, top = starts(counts[place])[first], starts(best[place])[first]
            column = {n: batch.column(n) for n in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")}
            column |= {"n_links": pa.array(np.diff(first)), "n_best": pa.array(np.diff(top)), "count_sum": pa.array(np.diff(weight))}
            names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([column[n] for n in names], names)

    return rows.mapInArrow(run, SCHEMA)
