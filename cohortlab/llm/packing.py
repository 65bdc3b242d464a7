"""Packing documents into fixed windows by non-negative least squares.

A document's ids fill whole windows first; the rest, shorter than a window, counts
into a histogram of lengths. Shallow combinations (two or three lengths that fill a
window exactly) are enumerated, and their repeat counts solve a non-negative least
squares problem against the histogram. The rounded counts that the histogram
affords become sequences; the remaining pieces are packed greedily one behind the
other and cut at window ends. What the last window would lack is avoided by
splitting it into lengths that are powers of two.

Only the histogram (fewer entries than a window has tokens) reaches the driver.
Which piece goes where follows from its rank among pieces of equal length, a
two-level count over hashed buckets, so a length that many documents share is
spread over tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored
from .token_ids import encoded, id_kind

WINDOW = 2048
END_ID = 1
FREQUENT = 48             # lengths that triples are built from
SWEEPS = 40               # coordinate descent passes over the combinations
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long,"
          " sequence_id long, offset long")


def combinations(counts: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Pairs and triples of occurring lengths that fill a window exactly."""
    have = counts > 0
    found = [(a, window - a) for a in range(1, window // 2 + 1) if have[a] and have[window - a]]
    often = sorted(np.argsort(-counts, kind="stable")[:FREQUENT].tolist())
    often = [a for a in often if have[a]]
    for x, a in enumerate(often):
        for b in often[x:]:
            c = window - a - b
            if c >= b and have[c]:
                found.append((a, b, c))
    return found


def repeat_counts(combos: list[tuple[int, ...]], counts: np.ndarray) -> np.ndarray:
    """min ||A x - counts||, x >= 0, by coordinate descent; column j counts the lengths of combination j."""
    left = counts.astype(float)
    columns = [np.unique(c, return_counts=True) for c in combos]
    x = np.zeros(len(combos))
    for _ in range(SWEEPS):
        moved = 0.0
        for j, (at, times) in enumerate(columns):
            step = float(left[at] @ times) / float(times @ times)
            step = max(step, -x[j])
            if step:
                x[j] += step
                left[at] -= step * times
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


class Plan:
    """Where the piece of a given length and rank goes."""

    def __init__(self, counts: np.ndarray, window: int = WINDOW):
        self.window = window
        combos = combinations(counts, window)
        wanted = np.floor(repeat_counts(combos, counts)).astype(np.int64)
        used = np.zeros(len(counts), np.int64)
        rows = []                                    # (length, first rank, repeats, first sequence, offset)
        sequence = 0
        for extra in (False, True):                  # rounded counts first, then what still fits
            for combo, want in zip(combos, wanted.tolist()):
                at, times = np.unique(combo, return_counts=True)
                room = int(((counts[at] - used[at]) // times).min())
                n = room if extra else min(want, room)
                if n <= 0:
                    continue
                offset = 0
                for length in combo:
                    rows.append((length, int(used[length]), n, sequence, offset))
                    used[length] += n
                    offset += length
                sequence += n
        rows.sort()
        self.rows = np.array(rows, np.int64).reshape(-1, 5)
        self.first = np.searchsorted(self.rows[:, 0], np.arange(len(counts) + 1))
        self.used, self.sequences = used, sequence
        rest = counts - used
        self.stream = np.concatenate([[0], np.cumsum(rest * np.arange(len(counts)))])
        total = int(self.stream[-1])
        ends = list(range(window, total + 1, window))
        tail = total - total // window * window
        for bit in reversed(range(window.bit_length())):
            if tail >> bit & 1:
                ends.append((ends[-1] if ends else 0) + (1 << bit))
        self.whole, self.total = total // window, total
        self.tail_ends = np.array([e for e in ends[self.whole:]], np.int64)
        self.sequences_end = sequence + len(ends)

    def place(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(piece length, sequence, offset) of one remainder; more than one entry where it is cut."""
        if rank < self.used[length]:
            rows = self.rows[self.first[length]:self.first[length + 1]]
            row = rows[np.searchsorted(rows[:, 1], rank, "right") - 1]
            return [(length, int(row[3] + rank - row[1]), int(row[4]))]
        out, at = [], int(self.stream[length] + (rank - self.used[length]) * length)
        stop = at + length
        while at < stop:
            if at < self.whole * self.window:
                number = at // self.window
                begin, end = number * self.window, (number + 1) * self.window
            else:
                k = int(np.searchsorted(self.tail_ends, at, "right"))
                number, end = self.whole + k, int(self.tail_ends[k])
                begin = int(self.tail_ends[k - 1]) if k else self.whole * self.window
            out.append((min(stop, end) - at, self.sequences + number, at - begin))
            at = min(stop, end)
        return out


def ranked(pieces: DataFrame, buckets: int) -> DataFrame:
    """(_row, _rank): 0-based rank of each row among those of equal ``_rest``, rows in any number per value."""
    spread = pieces.withColumn("_b", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    sizes = spread.groupBy("_rest", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_rest").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_rest", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_rest", "_b").orderBy("_row")
    return (spread.withColumn("_in", F.row_number().over(own) - 1).join(offsets, ["_rest", "_b"])
            .select("_row", (F.col("_before") + F.col("_in")).alias("_rank")))


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of the rows of ``docs(doc_id, text)`` with their sequence and offset.

    Each row's ids and the end id lie in exactly one piece each. A null or empty text is
    its end id alone; null ids stay null; repeated rows are packed each for itself; other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = id_kind(path)
    size = np.dtype(kind).itemsize
    ids = stored(encoded(docs, path, end_id, kind).withColumn("_row", F.monotonically_increasing_id()),
                 "packing-ids", compression="zstd")
    rest = ids.select("_row", (F.col("n_tokens") % window).cast("int").alias("_rest"), (F.col("n_tokens")).alias("_n"))
    counts, whole = np.zeros(window, np.int64), 0
    for r in rest.groupBy("_rest").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(f"_n div {window}")).alias("w")).collect():
        counts[r["_rest"]], whole = r["n"], whole + r["w"]
    counts[0] = 0
    plan = Plan(counts, window)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # whole windows get sequence numbers behind all others, by a rank over documents with any
    ranks = ranked(rest.select("_row", "_rest"), buckets)
    long_rank = long_offsets(rest.filter(F.col("_n") >= window), window, buckets)
    placed = ids.join(ranks, "_row").join(long_rank, "_row", "left")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, packed, rank, first in zip(batch.column("doc_id").to_pylist(), batch.column("ids"),
                                                batch.column("_rank").to_pylist(), batch.column("_first").to_pylist()):
                own = np.frombuffer(packed.as_buffer(), kind).astype("<u4")
                n = len(own)
                cuts = [(window, plan.sequences_end + first + k, 0) for k in range(n // window)]
                if n % window:
                    cuts += plan.place(n % window, rank)
                at = 0
                for length, sequence, offset in cuts:
                    rows.append((doc, at, length, zlib.crc32(own[at:at + length]), n, sequence, offset))
                    at += length
                if len(rows) >= 20_000:
                    yield as_batch(rows)
                    rows = []
            if rows:
                yield as_batch(rows)

    return placed.select("doc_id", "ids", "_rank", "_first").mapInArrow(pieces, SCHEMA)


def long_offsets(long_docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """(_row, _first): number of whole windows in the documents before, a running sum in two levels."""
    spread = long_docs.select("_row", F.expr(f"_n div {window}").alias("_w"),
                              F.pmod(F.xxhash64("_row"), F.lit(buckets)).alias("_b"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)      # one row per bucket
    offsets = spread.groupBy("_b").agg(F.sum("_w").alias("_n")).select(
        "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_b").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    return (spread.withColumn("_in", F.coalesce(F.sum("_w").over(own), F.lit(0))).join(offsets, "_b")
            .select("_row", (F.col("_before") + F.col("_in")).alias("_first")))


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)
