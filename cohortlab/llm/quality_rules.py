"""Quality rules: base counts and compression bands.

Repetitive text compresses too well, noise too badly. Each text is compressed
with zstandard as a whole and in fixed chunks that cover all its bytes; the ratio
(bytes / compressed bytes) must lie inside limits that depend on the length, since
the ratio of ordinary prose rises with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .arrays import SPACE, Hashes, U, Words, docs_of, mix, per_doc, release

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
NOT_CONTINUATION = (np.arange(256) & 0xC0) != 0x80
MIN_WORDS = 50                    # fewer words fail the base rule
MAX_REPEAT_PERCENT = 50           # more words inside repeated windows fail it
#: length below which a row holds -> (lowest, highest) ratio, of whole texts and of chunks of that length alike.
#: The lowest lie between random letters, digits and signs (also in base64) and prose, code or tables of that length.
LIMITS = ((256, 1.0, 2.6), (512, 1.09, 3.0), (1024, 1.22, 3.6), (4096, 1.32, 4.6), (32768, 1.4, 8.0), (float("inf"), 1.4, 12.0))
#: texts of fewer bytes than the first are cut into chunks of so many bytes
CHUNKS = ((4096, 256), (float("inf"), 1024))
MAX_BAD_CHUNKS = 0.2              # more bad chunks than this share reject a text

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
          " n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks double")


def line_hashes(data: np.ndarray, off: np.ndarray, h: Hashes):
    """(document, hash, has a word) of every line, split at newline bytes only."""
    nl = np.flatnonzero(data == 10)
    start = np.concatenate([off[:-1], nl + 1])
    end = np.concatenate([off[1:], nl])
    start.sort()
    end.sort()
    # a newline at the last byte of a document leaves an empty line at its end: same sorted order
    doc = np.searchsorted(off[1:], start, "right")
    doc = np.minimum(doc, len(off) - 2)
    words = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~SPACE[data], out=words[1:])
    return doc, h.of(start, end), words[end] > words[start]


def duplicates(doc: np.ndarray, h: np.ndarray, n_docs: int) -> np.ndarray:
    """How many entries of each document equal an earlier entry of it."""
    key = mix(h + (doc.astype(np.uint64) + U(1)) * U(0xD6E8FEB86659FD93))
    _, first = np.unique(key, return_index=True)
    all_, firsts = np.bincount(doc, minlength=n_docs), np.bincount(doc[first], minlength=n_docs)
    return all_ - firsts


def base_counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The contract's counts for the documents of one slice."""
    n = len(off) - 1
    w, h = Words(data, off), Hashes(data)
    at, gram = w.grams(h.of(w.start, w.end), 3)
    covered = np.zeros(len(w.start) + 2, bool)
    if len(at):
        key = mix(gram + (w.doc[at].astype(np.uint64) + U(1)) * U(0xD6E8FEB86659FD93))
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        repeated = at[counts[inverse] > 1]
        for j in range(3):
            covered[repeated + j] = True
    sums = np.concatenate([[0], np.cumsum(covered[:len(w.start)])])
    doc, lines, worded = line_hashes(data, off, h)
    return {
        "n_words": w.count,
        "word_chars": per_doc(w.inside & NOT_CONTINUATION[data], off),
        "n_symbols": per_doc(SYMBOL[data], off),
        "n_dup_lines": duplicates(doc[worded], lines[worded], n),
        "n_repeat_words": sums[w.first[1:]] - sums[w.first[:-1]],
    }


def inside(n_bytes: int, ratio: float) -> bool:
    low, high = next((lo, hi) for limit, lo, hi in LIMITS if n_bytes < limit)
    return low <= ratio <= high


def chunk_starts(n: int, size: int) -> list[int]:
    """Starts of chunks that cover every byte: the last one ends with the text and may overlap the one before.

    A text shorter than a chunk has none; its whole ratio decides.
    """
    starts = list(range(0, n - size + 1, size))
    return starts + [n - size] if starts and n % size else starts


def compression(text: memoryview, packer: zstandard.ZstdCompressor) -> tuple[float, float]:
    """(ratio of the whole text, share of its chunks outside their limits)."""
    n = len(text)
    if not n:
        return 1.0, 0.0
    ratio = n / len(packer.compress(text))
    size = next(size for limit, size in CHUNKS if n < limit)
    starts = chunk_starts(n, size)
    bad = sum(not inside(size, size / len(packer.compress(text[i:i + size]))) for i in starts)
    return ratio, bad / len(starts) if starts else 0.0


def verdict(n_bytes: int, ratio: float, bad: float) -> bool:
    return inside(n_bytes, ratio) and bad <= MAX_BAD_CHUNKS


def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
    for batch in batches:
        ids = batch.column("doc_id")
        for i, j, data, off in docs_of(batch):
            c = base_counts(data, off)
            view = memoryview(np.ascontiguousarray(data))
            pairs = [compression(view[a:b], packer) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
            kept = [not f and verdict(int(n), r, b) for f, n, (r, b) in zip(failed, np.diff(off), pairs)]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, j - i).cast(pa.int64()), *(pa.array(c[k], pa.int64()) for k in (
                    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                 pa.array(failed), pa.array(kept, pa.bool_()),
                 pa.array([r for r, _ in pairs], pa.float64()), pa.array([b for _, b in pairs], pa.float64())],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                 "base_failed", "kept", "ratio", "bad_chunks"])


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)`` with its counts, ratios and verdict.

    Null or empty text: no words, so ``base_failed``. A null id stays null. Repeated rows
    each get their row; other columns are ignored. No shuffle; an empty table gives no rows.
    """
    return docs.select("doc_id", "text").mapInArrow(score_batches, SCHEMA)


def accepted(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the rules keep, every column as it was.

    A null or empty text has no words and goes. Ids are not read, so null and repeated ids make no
    difference; repeated rows are judged alike. An empty table stays empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column("text")], ["doc_id", "text"])
            kept = [k for out in score_batches(iter([own])) for k in out.column("kept").to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)
