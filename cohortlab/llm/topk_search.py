"""Exact top-k inner products by no-random-access aggregation.

Each dimension of a block of candidates is a list sorted by value. For a query the
lists are read from the end its weight prefers, all to the same depth. A row's lower
bound adds the worst value of each list to the entries read, its upper bound the
value at the list's frontier. Reading stops when no row outside can reach the k-th
best lower bound: neither one that no list has shown yet (the sum of the frontiers)
nor one whose upper bound is below. The rows left get their final scores.

A list has shown a row exactly when the row's entry is not behind the frontier, so the
state after reading is one comparison of the block's contributions with the frontiers.
Queries meet candidates in blocks of bounded size; Spark deals out the block pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

K = 20
CANDIDATE_BLOCK, QUERY_BLOCK = 16384, 1024
DEPTHS = (0.5, 0.6, 0.7, 0.76, 0.82, 0.88, 0.94, 1.0)    # shares of a list read before bounds are looked at
FEW = 256                                       # so few rows left: resolve them at once
SCHEMA = "query_id long, vec_id long, score long"


def vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(64 * component) as longs, rows with nulls or non-finite components left out.

    Rows that repeat an id are one vector, the smallest; rows without an id take no part.
    """
    parts = table.select(F.col(id_col).cast("long").alias("vec_id"),
                         F.col(vector_col).cast("array<double>").alias("e"))
    sound = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (parts.filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull()).filter(sound)
            .groupBy("vec_id").agg(F.min("e").alias("e"))
            .select("vec_id", F.transform("e", lambda x: F.floor(x * 64)).alias("v")))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column; components that a shorter vector lacks are 0."""
    rows = column.combine_chunks()
    size = np.diff(rows.offsets.to_numpy())
    out = np.zeros((len(rows), width), np.int64)
    out[np.repeat(np.arange(len(rows)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = \
        rows.flatten().to_numpy(zero_copy_only=False)
    return out


class Block:
    """Distinct candidate vectors, their ids, and the sorted list of each dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        order = np.argsort(ids)
        ids, rows = ids[order], rows[order]
        self.rows, inverse = np.unique(rows, axis=0, return_inverse=True)
        by_row = np.argsort(inverse.ravel(), kind="stable")          # ids ascend within a vector
        bound = np.searchsorted(inverse.ravel()[by_row], np.arange(len(self.rows) + 1))
        self.ids = [ids[by_row[a:min(b, a + k + 1)]] for a, b in zip(bound[:-1], bound[1:])]
        self.lists = np.sort(self.rows, axis=0)
        self.largest = float(np.abs(self.rows.astype(float)).max(initial=0))
        self.values = self.rows.astype(np.float32 if self.largest < 1 << 24 else np.float64)
        self.start = 0

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the best ``k`` besides the query's own row.

        Reading begins at the depth that was the first to rule rows out for the query before.
        """
        n = len(self.rows)
        top = self.largest * float(np.abs(query.astype(float)).max(initial=0)) * len(query)
        weight = query.astype(np.float32 if top < 1 << 24 else np.float64)        # sums below 2**24 are exact
        up = weight > 0
        own = self.values * weight
        worst = np.where(up, self.lists[0], self.lists[-1]).astype(weight.dtype) * weight
        ones = np.ones(len(query), own.dtype)
        slack = 0.0 if top < 1 << 53 else 1e-9 * top
        alive = np.arange(n)
        for step in range(self.start, len(DEPTHS)):
            if len(alive) <= max(FEW, k + 1):        # resolve them; the unseen rows, frontier.sum() at most, are out
                break
            at = min(int(n * DEPTHS[step]), n - 1)
            frontier = np.where(up, self.lists[n - 1 - at], self.lists[at]).astype(own.dtype) * weight
            high = np.maximum(own, frontier) @ ones
            # an entry not read yet counts as the list's worst value in the lower bound
            low = high - (own < frontier).astype(own.dtype) @ (frontier - worst).astype(own.dtype)
            bar = np.partition(low, len(low) - k - 1)[len(low) - k - 1] - slack
            stay = high >= bar
            if 2 * stay.sum() < len(stay):
                if len(alive) == n:
                    self.start = step
                own, alive = own[stay], alive[stay]
        return alive

    def best(self, query: np.ndarray, query_id: int, k: int) -> list[tuple[int, int]]:
        alive = self.candidates(query, k)
        score = self.rows[alive] @ query
        if len(alive) > k + 1:
            bar = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
            alive, score = alive[score >= bar], score[score >= bar]
        found = [(-s, i) for s, a in zip(score.tolist(), alive.tolist()) for i in self.ids[a].tolist() if i != query_id]
        return [(i, -s) for s, i in sorted(found)[:k]]


def cell(k: int):
    def search(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if candidates.num_rows and queries.num_rows:
            width = max(int(np.diff(t.column("v").combine_chunks().offsets.to_numpy()).max(initial=0))
                        for t in (candidates, queries))
            block = Block(candidates.column("vec_id").to_numpy(), matrix(candidates.column("v"), max(width, 1)), k)
            for q, row in zip(queries.column("vec_id").to_pylist(), matrix(queries.column("v"), max(width, 1))):
                out += [(q, i, s) for i, s in block.best(row, q, k)]
        cols = zip(*out) if out else ((), (), ())
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    return search


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's best ``k`` candidates other than its own id.

    Both sides come from ``vectors``. Ties go to the smaller id; equal vectors are compared
    once. Empty sides give no rows. Scores are exact in 64-bit integers.
    """
    blocks_c = max(1, -(-candidates.count() // CANDIDATE_BLOCK))
    blocks_q = max(1, -(-queries.count() // QUERY_BLOCK))

    def dealt(df, own, n_own, other, n_other):
        return df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(n_own)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    pairs = (dealt(candidates, "_c", blocks_c, "_q", blocks_q).groupBy("_c", "_q")
             .cogroup(dealt(queries, "_q", blocks_q, "_c", blocks_c).groupBy("_c", "_q"))
             .applyInArrow(cell(k), SCHEMA))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def search_table(embeddings: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """Queries: vectors whose id is divisible by ``every``; candidates: all vectors."""
    known = stored(vectors(embeddings), "topk-vectors")
    return top_k(known, known.filter(F.col("vec_id") % every == 0), k)
