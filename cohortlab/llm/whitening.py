"""Whitening of embeddings from an exact scatter matrix.

Entries become integers ``x = floor(64 * c) + 1000000``. The cross-products of the distinct
vectors are counted on bit planes: in a block of rows each dimension is shifted by its
smallest entry, the bits of one weight of one dimension are packed across the rows into
64-bit words (a plane), and the sum over rows of a product of two dimensions is the sum over
pairs of their planes of ``2**(p + q) * popcount(plane & plane)``. Shifts are put back and
blocks are added with whole numbers of any size, so the covariance is exact before its one
rounding to double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import release
from .tables import long_rows

SCALE, ORIGIN = 64, 1_000_000
LARGEST = 2.0 ** 62           # an entry of this size has no integer of 64 bits
COMPONENTS = 16
BLOCK_ROWS = 1 << 14          # rows of one set of planes: 256 words
RESULT_ROWS = 1 << 12         # input rows of one output batch
SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


def integers(col: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(row numbers, x vectors) of the usable vectors: not null, no null or non-finite entry, within 64 bits."""
    rows, out = [], []
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    valid = np.asarray(col.is_valid())
    start = np.asarray(col.offsets[:-1].cast(pa.int64()))
    end = np.asarray(col.offsets[1:].cast(pa.int64()))
    flat = col.values.cast(pa.float64())
    c = flat.to_numpy(zero_copy_only=False)          # a null entry reads as NaN
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(SCALE * c)
        usable = np.isfinite(c) & (np.abs(scaled) < LARGEST)
    bad = np.concatenate([[0], np.cumsum(~usable)])
    x = np.where(usable, scaled, 0).astype(np.int64) + ORIGIN
    for r in np.flatnonzero(valid & (bad[end] == bad[start])).tolist():
        rows.append(r)
        out.append(x[start[r]:end[r]])
    return np.array(rows, np.int64), out


def quantised(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, x) of the usable rows; x is the vector's 64-bit integers as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = integers(batch.column("v"))
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(rows)),
                                              pa.array([v.astype("<i8").tobytes() for v in x], pa.binary())], ["vec_id", "x"])
        release()

    long_rows(vectors.sparkSession)
    return vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(
        run, "vec_id long, x binary")


def plane_products(y: np.ndarray) -> np.ndarray:
    """Sum over rows of y[i] * y[j] for the rows x dimensions matrix ``y`` of unsigned integers, from bit planes.

    Exact: whole numbers of any size when 64 bits could overflow.
    """
    n, d = y.shape
    bits = np.array([int(m).bit_length() for m in y.max(axis=0)])
    first = np.concatenate([[0], np.cumsum(bits)])
    words = -(-n // 64)
    planes = np.zeros((first[-1], words * 8), np.uint8)
    for p in range(bits.max(initial=0)):
        has = np.flatnonzero(bits > p)
        packed = np.packbits(((y[:, has] >> np.uint64(p)) & np.uint64(1)).astype(np.uint8), axis=0)
        planes[first[has] + p, :packed.shape[0]] = packed.T
    planes = planes.view(np.uint64)
    counts = np.zeros((len(planes), len(planes)), np.int64)
    for k in range(len(planes)):
        counts[k, k:] = np.bitwise_count(planes[k] & planes[k:]).sum(axis=1, dtype=np.int64)
    counts = np.triu(counts) + np.triu(counts, 1).T
    weight = np.concatenate([np.arange(b) for b in bits]) if len(planes) else np.zeros(0, np.int64)
    fits = 2 * bits.max(initial=0) + n.bit_length() < 62
    scaled = (counts if fits else counts.astype(object)) * (1 << weight.astype(np.int64 if fits else object))
    scaled = scaled * (1 << weight.astype(scaled.dtype))[:, None]
    live = np.flatnonzero(bits > 0)
    out = np.zeros((d, d), object)
    if len(live):
        part = np.add.reduceat(np.add.reduceat(scaled, first[live], axis=0), first[live], axis=1)
        out[np.ix_(live, live)] = part.astype(object)
    return out


class Sums:
    """Count, sums and cross-products of x vectors as whole numbers of any size."""

    def __init__(self, d: int):
        self.n, self.s, self.c = 0, np.zeros(d, object), np.zeros((d, d), object)

    def add(self, x: np.ndarray) -> None:
        """Rows x dimensions, 64-bit."""
        low = x.min(axis=0)
        y = x.astype(np.uint64) - low.astype(np.uint64)        # modulo 2**64: the difference is never negative
        half = (y >> np.uint64(32)).sum(axis=0).astype(object) * (1 << 32)
        sums = half + (y & np.uint64(0xFFFFFFFF)).sum(axis=0).astype(object)
        a, n = low.astype(object), len(x)
        self.c += plane_products(y) + np.outer(a, sums) + np.outer(sums, a) + n * np.outer(a, a)
        self.s += sums + n * a
        self.n += n


def scatter(fit_list: DataFrame, d: int) -> Sums:
    """Sums over ``fit_list(x binary)``: blocks in tasks, their numbers added by Spark.

    What comes to the driver is one number per pair of dimensions. Entries are taken off their
    origin, so that 38 digits hold the sums; a sum beyond them is an error, never wrong.
    """
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kept, rows = Sums(d), [], 0

        def flush():
            total.add(np.frombuffer(b"".join(kept), "<i8").reshape(-1, d) - ORIGIN)
            kept.clear()
        for batch in batches:
            for v in batch.column("x"):
                kept.append(v.as_py())
                if len(kept) == BLOCK_ROWS:
                    flush()
        if kept:
            flush()
        if total.n:
            values = [total.n, *total.s, *total.c[upper]]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()),
                                              pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))], ["at", "v"])

    found = fit_list.mapInArrow(run, "at int, v decimal(38,0)").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = Sums(d)
    if not found:
        return out
    v = {r["at"]: int(r["v"]) for r in found}
    out.n = v[0]
    s = np.array([v[1 + i] for i in range(d)], object)
    c = np.zeros((d, d), object)
    c[upper] = [v[1 + d + i] for i in range(len(upper[0]))]
    c = np.triu(c) + np.triu(c, 1).T
    out.c = c + ORIGIN * (np.add.outer(s, s)) + out.n * ORIGIN * ORIGIN
    out.s = s + out.n * ORIGIN
    return out


class Whitening(NamedTuple):
    n: int
    sums: tuple[int, ...]         # S: per dimension
    vectors: np.ndarray           # dimensions x components, unit length
    values: np.ndarray            # eigenvalues, falling
    explained: np.ndarray
    identity_error: float

    @property
    def rank(self) -> int:
        """Components with variance beyond rounding."""
        return int((self.values > 0).sum())


def fit(sums: Sums, components: int = COMPONENTS) -> Whitening:
    """Eigenvectors of the covariance; centred as integers, n * C - S S', then rounded once."""
    d, n = len(sums.s), sums.n
    if n == 0:
        return Whitening(n, tuple(sums.s), np.zeros((d, 0)), np.zeros(0), np.zeros(0), 0.0)
    centred = n * sums.c - np.outer(sums.s, sums.s)
    v = np.array([[int(c) / (n * n) for c in row] for row in centred])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    trace = int(np.trace(centred)) / (n * n)
    values = np.where(values > max(values[0], 0) * d * np.finfo(float).eps, values, 0.0)
    live = values > 0
    w = vectors[:, live] / np.sqrt(values[live])
    error = float(np.abs(w.T @ v @ w - np.eye(int(live.sum()))).max(initial=0.0))
    return Whitening(n, tuple(int(s) for s in sums.s), vectors, values, values / trace if trace else values, error)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)**2; None beyond 64 bits.

    Arithmetic modulo 2**64 is exact where the true value fits; a float estimate tells where, and near
    the limit whole numbers of any size decide.
    """
    s = np.array([v % (1 << 64) for v in sums], np.uint64)
    diff = x.astype(np.uint64) * np.uint64(n % (1 << 64)) - s
    exact = (diff * diff).sum(axis=1, dtype=np.uint64).astype(np.int64)
    about = ((x.astype(float) * n - np.array([float(v) for v in sums])) ** 2).sum(axis=1)
    out: list[int | None] = exact.tolist()
    for r in np.flatnonzero(about > 2.0 ** 60).tolist():
        true = sum((n * int(v) - t) ** 2 for v, t in zip(x[r], sums))
        out[r] = true if true < 1 << 63 else None
    return out


def project(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Rows x components of whitened values; NaN where the component has no variance."""
    whole = np.array([s // model.n for s in model.sums], np.int64)
    rest = np.array([(s % model.n) / model.n for s in model.sums])
    centred = (x - whole).astype(float) - rest
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(model.values > 0, (centred @ model.vectors) / np.sqrt(model.values), np.nan)


def dimensions(rows: DataFrame) -> int:
    """Length of most vectors; the longest of several as frequent; 0 without any."""
    best = (rows.groupBy((F.octet_length("x") / 8).cast("int").alias("d")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col("d").desc()).limit(1).collect())
    return best[0]["d"] if best else 0


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened vectors in long form: (vec_id, component, n, deviation, whitened, explained, identity_error).

    Left out are rows whose vector is null, holds null or non-finite entries or entries that 64-bit
    integers can't hold, and vectors of another length than most (the longer of lengths as frequent).
    Equal vectors count once in the fit; every remaining row, repeated ones too, gives one row per
    component up to ``components`` and the number of dimensions. A component without variance (fewer
    distinct vectors than components, constant dimensions) has a null ``whitened`` and an ``explained``
    of 0 and takes no part in ``identity_error``. ``deviation`` is null where it exceeds 64 bits. Null
    keys stay null; other columns are never read; an empty table gives no rows.
    """
    rows = quantised(vectors, key, vector)
    d = dimensions(rows)
    if d == 0:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    rows = rows.filter(F.octet_length("x") == 8 * d)
    # equal vectors meet after a partial aggregate, so a vector that a third of the rows hold is one row a task
    model = fit(scatter(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")).select("x"), d), components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for batch in batches:
            for i in range(0, batch.num_rows, RESULT_ROWS):
                part = batch.slice(i, RESULT_ROWS)
                x = np.frombuffer(b"".join(part.column("x").to_pylist()), "<i8").reshape(part.num_rows, d)
                white = project(x, model).ravel()
                m = part.num_rows
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)),
                    pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(white, mask=np.isnan(white)), pa.array(np.tile(model.explained, m)),
                    pa.array(np.full(m * k, model.identity_error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, SCHEMA)
