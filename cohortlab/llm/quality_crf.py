"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is good or bad. A line's evidence comes from its own features and those of
its two neighbours, and from the labels next to it through transition weights. A text's
quality is the mean of its lines' marginal probabilities, weighted by length.

With two labels the forward and backward messages are single log-odds:
``r[t] = d[t] + la(t11 + r[t-1], t01) - la(t10 + r[t-1], t00)`` where ``d`` is the
evidence for good and ``la`` is log(exp + exp).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import SPACE, Hashes, U, Words, docs_of, mix, release
from .quality_rules import SYMBOL, line_hashes
from .tables import id_bucket

TRAIN_DOCS = 4000            # labelled rows the model is fitted on, at most
TRAIN_DOC_BYTES = 32 << 10   # longer labelled texts are left out of the fit
EPOCHS, RATE, PENALTY = 150, 0.05, 1e-3
HELD_OUT = (3, 1)            # crc32(id) mod 3 equal to 1 is never learned from

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


class Lines(NamedTuple):
    """Lines with a word of the texts of one slice; a text without any has one line without content."""

    features: np.ndarray      # lines x features, of the line itself
    weight: np.ndarray        # bytes that are not white space, at least 1
    first: np.ndarray         # text -> its first line


def _class(test: str) -> np.ndarray:
    out = np.zeros(256, bool)
    for c in range(128):
        out[c] = bool(getattr(chr(c), test)())
    return out


UPPER, ALPHA, DIGIT = _class("isupper"), _class("isalpha"), _class("isdigit")
HIGH = np.arange(256) >= 128
ENDING = np.zeros(256, bool)
ENDING[[ord(c) for c in ".!?:;\"')"]] = True
MARKS = np.zeros(256, bool)
MARKS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'-"]] = True


def line_features(data: np.ndarray, off: np.ndarray) -> Lines:
    n_docs = len(off) - 1
    h, w = Hashes(data), Words(data, off)
    nl = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([off[:-1], nl + 1]))
    end = np.sort(np.concatenate([off[1:], nl]))
    doc, line_hash, worded = line_hashes(data, off, h)
    lonely = np.ones(n_docs, bool)
    lonely[doc[worded]] = False
    # keep worded lines, and the first line of a text without one
    head = np.ones(len(doc), bool)
    head[1:] = doc[1:] != doc[:-1]
    keep = worded | (head & lonely[doc])
    start, end, doc, line_hash = start[keep], end[keep], doc[keep], line_hash[keep]

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return (sums[end] - sums[start]).astype(float)

    solid = count(~SPACE[data])
    size = np.maximum(solid, 1)
    letters = np.maximum(count(ALPHA[data] | HIGH[data]), 1)
    word = h.of(w.start, w.end)
    lower, upper = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
    n = (upper - lower).astype(float)
    many = np.maximum(n, 1)
    line = np.repeat(np.arange(len(start)), upper - lower)
    word = word[np.repeat(lower - np.cumsum(upper - lower) + (upper - lower), upper - lower) + np.arange(len(line))]
    key = mix(word + (line.astype(np.uint64) + U(1)) * U(0xD6E8FEB86659FD93))
    distinct = np.bincount(line[np.unique(key, return_index=True)[1]], minlength=len(start)) if len(line) else np.zeros(len(start))
    follow = np.bincount(line[1:][(word[1:] == word[:-1]) & (line[1:] == line[:-1])], minlength=len(start)) if len(line) > 1 else np.zeros(len(start))
    same = mix(line_hash + (doc.astype(np.uint64) + U(1)) * U(0xD6E8FEB86659FD93))
    _, inverse, copies = np.unique(same, return_inverse=True, return_counts=True)
    last = data[np.maximum(end - 1, 0)] if len(data) else np.zeros(len(end), np.uint8)
    symbols, marks, caps = count(SYMBOL[data]) / size, count(MARKS[data]) / size, count(UPPER[data]) / letters
    features = np.stack([
        np.ones(len(start)), np.log1p(n) / 4, np.minimum(size / many, 20) / 10, caps, caps > 0.5, symbols * 4, symbols > 0.05,
        marks * 4, marks > 0.08, count(DIGIT[data]) / size, count(HIGH[data]) / size,
        distinct / many, follow / many, follow / many > 0.3, (copies[inverse] > 1) * 1.0, ENDING[last] & (n > 0), n < 5,
    ], axis=1)
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    return Lines(features, size, first)


def with_neighbours(lines: Lines) -> np.ndarray:
    """Each line's features, then those of the line before and after inside its text (zeros at the ends)."""
    x = lines.features
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(x) > 1:
        before[1:], after[:-1] = x[:-1], x[1:]
    inner = lines.first[:-1]
    before[inner] = 0
    after[lines.first[1:] - 1] = 0
    return np.concatenate([x, before[:, 1:], after[:, 1:]], axis=1)


def messages(d: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward log-odds (evidence included) and backward log-odds of every line, all texts side by side."""
    t00, t01, t10, t11 = trans
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    r, b = d.copy(), np.zeros_like(d)
    active = np.searchsorted(-size, -np.arange(2, (size[0] if len(size) else 0) + 1), "right")
    for t, a in enumerate(active, 1):
        at = start[:a] + t
        p = r[at - 1]
        r[at] += np.logaddexp(t11 + p, t01) - np.logaddexp(t10 + p, t00)
    for t, a in reversed(list(enumerate(active, 1))):
        at = start[:a] + t
        p = d[at] + b[at]
        b[at - 1] = np.logaddexp(t11 + p, t10) - np.logaddexp(t01 + p, t00)
    return r, b


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class Model(NamedTuple):
    weights: np.ndarray
    trans: np.ndarray         # from bad to bad, bad to good, good to bad, good to good

    def scores(self, lines: Lines) -> np.ndarray:
        r, b = messages(with_neighbours(lines) @ self.weights, lines.first, self.trans)
        p = sigmoid(r + b)
        total = np.add.reduceat(lines.weight, lines.first[:-1])
        return np.clip(np.add.reduceat(p * lines.weight, lines.first[:-1]) / total, 0.0, 1.0)


def fit(docs: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> Model:
    """Maximise the conditional likelihood of the line labels (each line has its text's) with Adam.

    ``docs`` are (features of the lines, label). Texts count alike: the gradient of each is
    divided by its number of lines. Without both labels every score is the only label's side.
    """
    n = docs[0][0].shape[1] if docs else line_features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).features.shape[1]
    size = np.array([len(x) for x, _ in docs], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    x = with_neighbours(Lines(np.concatenate([x for x, _ in docs]) if docs else np.zeros((0, n)), np.zeros(0), first))
    label = np.array([y for _, y in docs], float)
    y, share = np.repeat(label, size), np.repeat(1 / np.maximum(size, 1), size) / max(len(docs), 1)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    inner = np.ones(len(x), bool)
    inner[first[:-1]] = False
    right = np.flatnonzero(inner)                  # lines with a line before them
    for step in range(1, epochs + 1 if len(docs) else 1):
        w, trans = theta[:-4], theta[-4:]
        d = x @ w
        r, b = messages(d, first, trans)
        grad = np.zeros_like(theta)
        grad[:-4] = x.T @ ((y - sigmoid(r + b)) * share)
        if len(right):
            l, z = r[right - 1], d[right] + b[right]
            logits = np.stack([trans[0] + 0 * l, trans[1] + z, trans[2] + l, trans[3] + l + z])
            p = np.exp(logits - logits.max(0))
            p /= p.sum(0)
            seen = np.stack([1 - y[right], 0 * l, 0 * l, y[right]])
            grad[-4:] = ((seen - p) * share[right]).sum(1)
        grad -= PENALTY * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta + RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Model(theta[:-4], theta[-4:])


def labelled_features(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> list[tuple[np.ndarray, int]]:
    """Line features of the training sample: labelled rows outside the held-out third, at most ``most``.

    The sample is taken by id hash; a row that repeats an id counts by its smallest label.
    """
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
              .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (id_bucket("doc_id", HELD_OUT[0]) != HELD_OUT[1]))
              .groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    label = {r.doc_id: r.y for r in chosen.collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            batch = batch.filter(pa.array([i in label for i in ids], pa.bool_()))
            if not batch.num_rows:
                continue
            ids = batch.column("doc_id").to_pylist()
            for i, j, data, off in docs_of(batch):
                lines = line_features(data, off)
                own = [lines.features[a:b].astype(np.float32).tobytes() for a, b in zip(lines.first[:-1], lines.first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], pa.int64()), pa.array(own, pa.binary())], ["doc_id", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(
        F.octet_length(F.coalesce("text", F.lit(""))) <= TRAIN_DOC_BYTES)
    rows = (texts.mapInArrow(run, "doc_id long, x binary")
            .groupBy("doc_id").agg(F.min("x").alias("x")).collect())       # an id may repeat any number of times
    n = line_features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).features.shape[1]
    rows.sort(key=lambda r: r.doc_id)
    return [(np.frombuffer(r.x, np.float32).reshape(-1, n).astype(float), label[r.doc_id]) for r in rows]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; the text is all that a score depends on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in docs_of(batch):
                s = model.scores(line_features(data, off))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("held_out").slice(i, j - i), pa.array(s),
                     pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held_out = (id_bucket("doc_id", HELD_OUT[0]) == HELD_OUT[1]).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, "text").mapInArrow(run, SCHEMA)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled sample, score every row of ``docs(doc_id, text)``.

    Null and empty texts have one line without content and are scored by it. Null ids stay
    null and count as the text "null" for the hold-out; repeated rows each give a row; other
    columns are never read; an empty table gives no rows, no labels give scores of 0.5.
    """
    return score(docs, fit(labelled_features(docs, labels)))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` that the model predicts to be good, every column as it was.

    A null or empty text is one line without content and is judged by it. Ids are not read, so null
    and repeated ids make no difference; repeated rows are judged alike. An empty table stays empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [model.scores(line_features(data, off)) >= 0.5 for _, _, data, off in docs_of(batch)]
            yield batch.filter(pa.array(np.concatenate(good))) if good else batch
        release()

    return docs.mapInArrow(run, docs.schema)
