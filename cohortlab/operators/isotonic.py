"""Isotonic regression of labels on scores, fitted and applied without gathering the scores.

Pooling adjacent violators gives the same blocks in whatever order neighbours are pooled. So the
distinct scores are dealt into ranges, each range is pooled in one task, and then only what
crosses a border is left: the second half of each range's blocks meets the first half of the
next one's, until the means rise across every border.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise
from .ordered import by_ranges, cumulative

CARRIED_BLOCKS = 100_000      # a fit of at most so many blocks travels with the scoring task; beyond, blocks are joined
CELL_BLOCKS = 1000            # blocks of one join cell
BLOCKS = "fit int, lo double, hi double, pos long, n long, grp long, at long, size long"


def pooled(pos: list[int], n: list[int]) -> list[tuple[int, int]]:
    """(first, one past the last) of each pool of neighbours whose means would not rise."""
    out: list[list[int]] = []
    for i, (p, m) in enumerate(zip(pos, n)):
        out.append([i, i + 1, p, m])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, end, p2, n2 = out.pop()
            out[-1][1:] = [end, out[-1][2] + p2, out[-1][3] + n2]
    return [(a, b) for a, b, _, _ in out]


def pool_groups(blocks: DataFrame) -> DataFrame:
    """Each group of neighbouring blocks pooled in one task; ``at`` and ``size`` count inside (group, fit)."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("fit", "ascending"), ("lo", "ascending")])
        fit, lo, hi, pos, n, grp = (table.column(c).to_pylist() for c in ("fit", "lo", "hi", "pos", "n", "grp"))
        rows, a = [], 0
        while a < len(fit):
            b = a
            while b < len(fit) and fit[b] == fit[a]:
                b += 1
            found = pooled(pos[a:b], n[a:b])
            rows += [(fit[a], lo[a + i], hi[a + j - 1], sum(pos[a + i:a + j]), sum(n[a + i:a + j]), grp[a], k, len(found))
                     for k, (i, j) in enumerate(found)]
            a = b
        columns = list(zip(*rows)) if rows else [[]] * 8
        kinds = [pa.int32(), pa.float64(), pa.float64(), *[pa.int64()] * 5]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split(" ")[0] for f in BLOCKS.split(", ")])

    return blocks.groupBy("grp").applyInArrow(run, BLOCKS)


def borders(blocks: DataFrame) -> DataFrame:
    """One row per (fit, group): its dense number, and whether its first mean does not rise above the last one before."""
    ends = blocks.groupBy("fit", "grp").agg(
        F.min_by(F.struct("pos", "n"), "lo").alias("first"), F.max_by(F.struct("pos", "n"), "lo").alias("last"))
    # a row per range: the only window without a data-sized partitioning
    order = Window.orderBy("fit", "grp")
    before, fit = F.lag("last").over(order), F.lag("fit").over(order)
    broken = (fit == F.col("fit")) & (before["pos"] * F.col("first.n") >= F.col("first.pos") * before["n"])
    return ends.select("fit", "grp", F.row_number().over(order).alias("number"), F.coalesce(broken, F.lit(False)).alias("broken"))


def fit_blocks(df: DataFrame, p: str, y: str, fold: str | None = None, folds: int = 1, n_buckets: int | None = None) -> DataFrame:
    """(fit, lo, hi, value, n): the isotonic blocks of every fit, rising; fit k leaves fold k out (without ``fold``
    one fit of all rows). Rows with a null score or label are left out."""
    rows = df.select(F.col(p).cast("double").alias("lo"), F.col(y).cast("long").alias("y"),
                     (F.col(fold) if fold else F.lit(-1)).cast("int").alias("f")).dropna()
    counts = rows.groupBy("lo", "f").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    of = F.array(*[F.lit(k) for k in range(folds)])
    long = (counts.withColumn("fit", F.explode(F.filter(of, lambda k: k != F.col("f")))).groupBy("fit", "lo")
            .agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")))
    dealt = by_ranges(long, ["fit", "lo"], n_buckets).select("fit", "lo", F.col("lo").alias("hi"), "pos", "n", F.col("_bucket").cast("long").alias("grp"))
    blocks, turn = materialise(pool_groups(dealt), "isotonic"), 0
    while True:
        table = materialise(borders(blocks), "isotonic-borders")
        if table.filter("broken").limit(1).count() == 0:
            return blocks.select("fit", "lo", "hi", (F.col("pos") / F.col("n")).alias("value"), "n")
        # neighbours meet in the group of the later one; a group's only block moves or stays by a hash, anew each turn
        up = F.when(F.col("size") > 1, 2 * F.col("at") >= F.col("size")).otherwise(F.xxhash64("number", F.lit(turn)) % 2 == 0)
        moved = (blocks.join(table, ["fit", "grp"])
                 .select("fit", "lo", "hi", "pos", "n", (F.col("number") + up.cast("int")).cast("long").alias("grp")))
        blocks, turn = materialise(pool_groups(moved), "isotonic"), turn + 1


@dataclass
class Steps:
    """One fit: its blocks as arrays when they are few, else the folder of its join cells."""

    xs: list[float] = field(default_factory=list)
    ys: list[float] = field(default_factory=list)
    cells: str | None = None
    starts: list[float] = field(default_factory=list)      # first score of each cell but the first


def points(blocks: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("lo").alias("x"), F.col("value").alias("v")), F.struct(F.col("hi").alias("x"), F.col("value").alias("v")))
    return blocks.withColumn("points", ends)


def as_steps(blocks: DataFrame, fit: int, n_blocks: int, carried: int = CARRIED_BLOCKS) -> Steps:
    own = blocks.filter(F.col("fit") == fit)
    if n_blocks <= carried:
        rows = own.select("lo", "hi", "value").orderBy("lo").collect()
        return Steps([x for r in rows for x in (r.lo, r.hi)], [v for r in rows for v in (r.value, r.value)])
    size = max(CELL_BLOCKS, -(-n_blocks // CARRIED_BLOCKS)) if carried == CARRIED_BLOCKS else 2
    ranked = cumulative(own.withColumn("one", F.lit(1)), ["fit"], "lo", ["one"])
    in_cell = points(ranked).withColumn("cell", F.floor((F.col("cum_one") - 1) / size).cast("long"))
    # the first point of a cell also ends the one before, so that values between cells are interpolated
    edge = in_cell.groupBy("cell").agg(F.min("lo").alias("lo"), F.min_by("value", "lo").alias("value"))
    more = edge.select((F.col("cell") - 1).alias("cell"), F.array(F.struct(F.col("lo").alias("x"), F.col("value").alias("v"))).alias("points"))
    whole = (in_cell.select("cell", "points").unionByName(more.filter("cell >= 0")).select("cell", F.explode("points").alias("q"))
             .groupBy("cell").agg(F.sort_array(F.collect_list("q")).alias("q"))
             .select("cell", F.col("q.x").alias("xs"), F.col("q.v").alias("ys")))
    stored = materialise(whole, "isotonic-cells")
    starts = [r.lo for r in edge.orderBy("cell").collect()][1:]
    return Steps(cells=stored.inputFiles()[0].rpartition("/")[0], starts=starts)


def fit_steps(df: DataFrame, p: str, y: str, fold: str | None = None, folds: int = 1, n_buckets: int | None = None,
              carried: int = CARRIED_BLOCKS) -> list[Steps]:
    """One set of steps per fit (see ``fit_blocks``)."""
    blocks = fit_blocks(df, p, y, fold, folds, n_buckets)
    sizes = {r["fit"]: r["count"] for r in blocks.groupBy("fit").count().collect()}
    return [as_steps(blocks, k, sizes.get(k, 0), carried) for k in range(folds)]


def apply_steps(df: DataFrame, fits: Sequence[Steps], p: str, outs: Sequence[str]) -> DataFrame:
    """``df`` with one column per fit: linear between the ends of neighbouring blocks, constant outside; null scores stay null."""
    carried = [(s, o) for s, o in zip(fits, outs) if s.cells is None]
    out = df
    if carried:
        tables = [(np.array(s.xs), np.array(s.ys)) for s, _ in carried]

        @F.pandas_udf(", ".join(f"c{i} double" for i in range(len(carried))))
        def value(x):
            import pandas as pd

            v = x.to_numpy(float)
            return pd.DataFrame({f"c{i}": np.where(np.isnan(v), np.nan, np.interp(v, xs, ys)) if len(xs) else np.full(len(v), np.nan)
                                 for i, (xs, ys) in enumerate(tables)}).astype("float64").replace({np.nan: None})
        found = out.withColumn("_steps", value(F.col(p).cast("double")))
        out = found.select(*out.columns, *[F.col(f"_steps.c{i}").alias(o) for i, (_, o) in enumerate(carried)])
    for s, o in zip(fits, outs):
        if s.cells is not None:
            out = by_cells(out, s, p, o)
    return out.select(*df.columns, *outs)


def by_cells(df: DataFrame, steps: Steps, p: str, out: str) -> DataFrame:
    """Rows meet the few blocks around their score by an equi-join on the cell."""
    spark: SparkSession = df.sparkSession
    starts = np.array(steps.starts)

    @F.pandas_udf("long")
    def cell_of(x):
        import pandas as pd

        return pd.Series(np.searchsorted(starts, x.to_numpy(float), "right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, xs, ys = (batch.column(batch.schema.get_field_index(c)) for c in ("_x", "_xs", "_ys"))
            got = [None if v is None else float(np.interp(v, a, b)) for v, a, b in zip(x.to_pylist(), xs.to_pylist(), ys.to_pylist())]
            keep = [n for n in batch.schema.names if n not in ("_x", "_xs", "_ys")]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in keep], pa.array(got, pa.float64())], [*keep, out])

    cells = spark.read.parquet(steps.cells).select(F.col("cell").alias("_cell"), F.col("xs").alias("_xs"), F.col("ys").alias("_ys"))
    x = F.col(p).cast("double")
    keyed = df.withColumn("_x", x).withColumn("_cell", F.when(x.isNotNull(), cell_of(x)))
    joined = keyed.join(cells, "_cell", "left").drop("_cell")
    schema = df.schema.add(out, "double")
    return joined.mapInArrow(run, schema)
