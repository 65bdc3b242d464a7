"""Language identification by unigrams over the pieces of a public vocabulary, all segmentations summed.

Each language has a probability for every piece of a fixed vocabulary (the byte strings of a
sentencepiece model, single bytes among them, so every text can be cut into pieces). A text
has many segmentations; its probability is the sum over all of them of the product of their
pieces' probabilities, by a forward pass over byte positions. Piece probabilities come from
expectation maximisation with the same lattice: expected piece counts over all segmentations
of a language's training words.

A text is scored word by word, each with a space before it; pieces do not cross words.
Positions of all words of a slice advance side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import piece_bytes
from .arrays import LOWER, Hashes, U, Words, byte_view, mix, release, slices
from .tables import id_bucket, long_rows

TRAIN_DOCS = 1000             # labelled texts a language is learned from: all up to so many, then about so many by hash
TRAIN_CHARS = 16_000          # of a longer training text so many characters are learned from; scoring reads whole texts
ITERATIONS = 6
UNIFORM = 0.01                # share of every language's probability spread evenly over all pieces
UNIT_BYTES = 48               # longer words are scored in parts of so many bytes, each with all its segmentations
SLICE = 3 << 20               # bytes of texts whose equal words are scored once
BLOCK_BYTES = 1 << 18         # bytes of distinct words of one lattice
LANGUAGES = 16                # columns of one forward pass
LIFT = 12.0                   # factor per byte that keeps probabilities of whole words inside double precision
HELD_OUT = 5                  # crc32(id) mod 5 equal to 0 is never learned from
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


# ------------------------------------------------------------------ vocabulary

class Trie:
    """Byte strings as paths; children in one open-addressed table keyed by (node, byte)."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = sorted(set(p for p in pieces if p) | {bytes([b]) for b in range(256)})
        self.longest = max(map(len, self.pieces))
        node, child, piece = {b"": 0}, [], [-1]
        for i, p in enumerate(self.pieces):               # sorted: prefixes come first
            for k in range(1, len(p) + 1):
                if p[:k] not in node:
                    node[p[:k]] = len(piece)
                    child.append((node[p[:k - 1]] << 8 | p[k - 1], len(piece)))
                    piece.append(-1)
            piece[node[p]] = i
        self.piece = np.array(piece, np.int32)
        self.bits = (2 * len(child)).bit_length()
        self.key, self.child = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        keys, ends = np.array(child, np.int64).T
        open_, at = np.arange(len(keys)), self.slot(keys)
        while len(open_):
            free = self.key[at] < 0
            won = np.zeros(len(open_), bool)
            won[np.unique(at, return_index=True)[1]] = True
            won &= free
            self.key[at[won]], self.child[at[won]] = keys[open_[won]], ends[open_[won]]
            open_, at = open_[~won], np.where(free, at, (at + 1) & ((1 << self.bits) - 1))[~won]

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key.astype(np.uint64)) >> U(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Child of each node along its byte, -1 where there is none."""
        key = node.astype(np.int64) << 8 | byte
        out = np.full(len(key), -1, np.int32)
        open_, at = np.arange(len(key)), self.slot(key)
        while len(open_):
            held = self.key[at]
            hit = held == key[open_]
            out[open_[hit]] = self.child[at[hit]]
            on = ~hit & (held >= 0)
            open_, at = open_[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out


_ready: dict[str, Trie] = {}


def trie(path: str) -> Trie:
    """One per Python worker and model file."""
    if path not in _ready:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        _ready[path] = Trie([p for i, p in enumerate(piece_bytes(model)) if not (model.is_control(i) or model.is_unknown(i))])
    return _ready[path]


# ------------------------------------------------------------------ lattices

class Lattice:
    """All pieces at all places of some units (byte strings), ordered by place and length inside the unit."""

    def __init__(self, data: np.ndarray, first: np.ndarray, t: Trie):
        self.size = np.diff(first)
        unit = np.repeat(np.arange(len(self.size)), self.size)
        start, end = np.arange(len(data)), first[1:][unit]
        node = np.zeros(len(data), np.int32)
        starts, sizes, pieces = [], [], []
        for depth in range(1, t.longest + 1):
            inside = start + depth <= end
            start, end, node = start[inside], end[inside], node[inside]
            node = t.step(node, data[start + depth - 1])
            go = node >= 0
            start, end, node = start[go], end[go], node[go]
            found = t.piece[node] >= 0
            starts.append(start[found])
            pieces.append(t.piece[node[found]])
            sizes.append(np.full(int(found.sum()), depth, np.int16))
        start, size, piece = np.concatenate(starts), np.concatenate(sizes), np.concatenate(pieces)
        group = ((start - first[unit[start]]) * (t.longest + 1) + size).astype(np.int16)
        order = np.argsort(group, kind="stable")
        start, group = start[order], group[order]
        self.piece, self.unit = piece[order], unit[start]
        self.source = start + self.unit                    # one more position than bytes in each unit
        self.target = self.source + size[order]
        self.lift = LIFT ** size[order].astype(float)
        cut = np.flatnonzero(np.diff(group)) + 1
        self.groups = list(zip([0, *cut.tolist()], [*cut.tolist(), len(group)])) if len(group) else []
        self.head = first[:-1] + np.arange(len(self.size))
        self.tail = self.head + self.size
        self.positions = len(data) + len(self.size)

    def forward(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum over segmentations of the bytes before each position, weight of each edge) for pieces x languages."""
        alpha = np.zeros((self.positions, p.shape[1]))
        alpha[self.head] = 1
        weight = p[self.piece] * self.lift[:, None]
        for a, b in self.groups:                           # in a group all targets differ
            alpha[self.target[a:b]] += alpha[self.source[a:b]] * weight[a:b]
        return alpha, weight

    def log_sums(self, p: np.ndarray) -> np.ndarray:
        """Units x languages: log of the summed probability."""
        alpha, _ = self.forward(p)
        return np.log(alpha[self.tail]) - np.log(LIFT) * self.size[:, None]

    def expected(self, p: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected number of each piece over all segmentations of all units, for one language."""
        alpha, weight = self.forward(p[:, None])
        alpha, weight = alpha[:, 0], weight[:, 0]
        beta = np.zeros(self.positions)
        beta[self.tail] = 1
        for a, b in reversed(self.groups):
            beta[self.source[a:b]] += weight[a:b] * beta[self.target[a:b]]
        share = alpha[self.source] * weight * beta[self.target] * (times / alpha[self.tail])[self.unit]
        return np.bincount(self.piece, share, len(p))


def blocks(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of units of about BLOCK_BYTES, at least one unit each."""
    total, a = np.cumsum(size), 0
    while a < len(size):
        b = max(int(np.searchsorted(total, (total[a - 1] if a else 0) + BLOCK_BYTES, "right")), a + 1)
        yield a, b
        a = b


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the ranges one behind the other, first byte of each)."""
    first = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(start - first[:-1], size) + np.arange(first[-1])], first


class Units(NamedTuple):
    """Space-led lower-cased words of the texts of a slice, long ones in parts; equal ones once."""

    data: np.ndarray
    first: np.ndarray             # distinct unit -> its bytes
    of: np.ndarray                # each unit in order of the texts: its number among the distinct ones
    text: np.ndarray              # and its text


def units_of(data: np.ndarray, off: np.ndarray) -> Units:
    w = Words(data, off)
    words, _ = gathered(LOWER[data], w.start, w.end - w.start)
    at = np.concatenate([[0], np.cumsum(w.end - w.start + 1)])
    room = np.full(len(words) + len(w.start), 32, np.uint8)        # a space before every word
    room[np.arange(len(words)) + np.repeat(np.arange(1, len(w.start) + 1), w.end - w.start)] = words
    parts = -(-(at[1:] - at[:-1]) // UNIT_BYTES)
    word = np.repeat(np.arange(len(parts)), parts)
    start = at[:-1][word] + UNIT_BYTES * (np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts))
    size = np.minimum(UNIT_BYTES, at[1:][word] - start)
    h = Hashes(room).of(start, start + size)
    _, one, of = np.unique(h, return_index=True, return_inverse=True)
    own, first = gathered(room, start[one], size[one])
    return Units(own, first, of, w.doc[word])


# ------------------------------------------------------------------ model

class Model(NamedTuple):
    path: str
    languages: list[str]          # sorted
    p: np.ndarray                 # pieces x languages

    def log_probabilities(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Texts x languages."""
        u, t = units_of(data, off), trie(self.path)
        size = np.diff(u.first)
        own = np.zeros((len(size), len(self.languages)))
        for a, b in blocks(size):
            first = u.first[a:b + 1]
            lattice = Lattice(u.data[first[0]:first[-1]], first - first[0], t)
            for k in range(0, len(self.languages), LANGUAGES):
                own[a:b, k:k + LANGUAGES] = lattice.log_sums(self.p[:, k:k + LANGUAGES])
        out = np.zeros((len(off) - 1, len(self.languages)))
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(u.text, own[u.of, k], len(off) - 1)
        return out


def learn(words: list[bytes], times: np.ndarray, t: Trie, iterations: int = ITERATIONS) -> np.ndarray:
    """Expected piece counts of one language after expectation maximisation from even probabilities."""
    size = np.array([len(w) for w in words], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(words), np.uint8)
    n = len(t.pieces)
    p, count = np.full(n, 1 / n), np.zeros(n)
    for _ in range(iterations):
        count = np.zeros(n)
        for a, b in blocks(size):
            own = first[a:b + 1]
            count += Lattice(data[own[0]:own[-1]], own - own[0], t).expected(p, times[a:b])
        p = (1 - UNIFORM) * count / count.sum() + UNIFORM / n
    return count


def texts_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row range, bytes, offsets) of the slices of a batch."""
    data, off = byte_view(batch.column("text"))
    for i, j in slices(off, SLICE):
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]


def training_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n): units of the training texts. Equal rows count once.

    A language's sample is those of its rows whose hash lies below TRAIN_DOCS / its number of rows:
    expected size TRAIN_DOCS, no sort, and a language of most rows is no hot key, since rows meet
    only after the sample is taken.
    """
    known = docs.select(
        F.col("lang").cast("string").alias("lang"), "text", F.xxhash64(F.col("doc_id").cast("long"), "text").alias("h")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_bucket("doc_id", HELD_OUT) != 0))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("_rows"))
    # one row a language, as the model that every task holds
    low = F.shiftrightunsigned("h", 1) / F.lit(2.0 ** 63) <= F.lit(TRAIN_DOCS) / F.col("_rows")
    chosen = (known.join(F.broadcast(sizes), "lang").filter(low)
              .groupBy("lang", "h").agg(F.min(F.substring("text", 1, TRAIN_CHARS)).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for i, j, data, off in texts_of(batch):
                u = units_of(data, off)
                n_units = len(u.first) - 1
                key, times = np.unique(u.text * max(n_units, 1) + u.of, return_counts=True)
                own, raw = u.first.tolist(), u.data.tobytes()
                text, unit = (key // max(n_units, 1)).tolist(), (key % max(n_units, 1)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([langs[i + d] for d in text], pa.string()),
                     pa.array([raw[own[x]:own[x + 1]] for x in unit], pa.binary()), pa.array(times, pa.int64())], ["lang", "word", "n"])

    return chosen.select("lang", "text").mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(
        F.sum("n").alias("n"))


def fit(docs: DataFrame, path: str) -> Model:
    """Piece probabilities of every language of the training rows that has a word there.

    A language is learned in one task from its bounded sample; what reaches the driver is one
    number per language and piece that occurs in it.
    """
    def run(group: pa.Table) -> pa.Table:
        t = trie(path)
        words = group.column("word").to_pylist()
        count = learn(words, np.array(group.column("n").to_pylist(), float), t)
        at = np.flatnonzero(count > 0)
        return pa.table([pa.array([group.column("lang")[0].as_py()], pa.string()),
                         pa.array([at.astype("<i4").tobytes()], pa.binary()),
                         pa.array([(count[at] / count.sum()).astype("<f8").tobytes()], pa.binary())], ["lang", "at", "p"])

    rows = training_words(docs).groupBy("lang").applyInArrow(run, "lang string, at binary, p binary").collect()
    rows.sort(key=lambda r: r.lang)
    n = len(trie(path).pieces)
    p = np.full((n, len(rows)), UNIFORM / n)
    for k, r in enumerate(rows):
        p[np.frombuffer(r["at"], "<i4"), k] += (1 - UNIFORM) * np.frombuffer(r["p"], "<f8")
    return Model(path, [r.lang for r in rows], p)


def with_letters(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    upper = LOWER[data]
    plain = np.concatenate([[0], np.cumsum((upper >= 97) & (upper <= 122))])[off]
    high = np.concatenate([[0], np.cumsum(data >= 128)])[off]
    found = plain[1:] > plain[:-1]
    for d in np.flatnonzero(~found & (high[1:] > high[:-1])).tolist():
        found[d] = any(c.isalpha() for c in data[off[d]:off[d + 1]].tobytes().decode())
    return found


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row; the text is all that a prediction depends on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            for i, j, data, off in texts_of(batch):
                best, score = np.full(j - i, len(model.languages)), np.zeros(j - i)
                if model.languages:
                    logs = model.log_probabilities(data, off)
                    known = with_letters(data, off)
                    best = np.where(known, logs.argmax(axis=1), best)
                    odds = np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                    score = np.where(known, 1 / odds, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("held_out").slice(i, j - i),
                     pa.array(names[best].tolist(), pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])
        release()

    held_out = (id_bucket("doc_id", HELD_OUT) == 0).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, "text").mapInArrow(run, SCHEMA)


def identify(docs: DataFrame, path: str) -> DataFrame:
    """Learn from the training rows of ``docs(doc_id, text, lang)``, predict every row.

    ``score`` is the language's share of the text's probability over all learned languages,
    each as likely before. Of equally probable languages the first by name is taken. Texts that
    are null or have no letter are "und" with score 0, as is every text where no training row
    has both a language and a word. Null ids stay null and count as the text "null" for the
    hold-out; repeated rows each give a row and count once in training; other columns are never
    read; an empty table gives no rows.
    """
    long_rows(docs.sparkSession)
    return predict(docs, fit(docs, path))
