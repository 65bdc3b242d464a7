"""Gradient boosting of many fits side by side.

All (learner, held-out fold) fits over a table grow together. Features are quantised once into
a byte matrix, kept in blocks of rows in the shared folder, beside every fit's scores. Tasks map the
blocks into memory: no row passes between the JVM and Python again, whatever the number of jobs, and
any task may be run again anywhere. Scores are written anew for each tree. One Spark job per tree
level adds up the histograms (gradient, second derivative, rows) of all fits, all nodes and
the features drawn for the tree; of two children only the smaller is counted, the other is its
parent less it. The last children of a tree are not counted: their sums follow from the split.
Splits are chosen on the driver from the histograms, whose size depends on fits, nodes,
features and bins only.

Inside a task a node's rows are found by comparing whole columns of bytes, never row by row. Only
the rows that a job counts get their gradients, in buffers that all fits of a block share, and
two features are counted at a time: one table over both, summed along either side.

Gradients are rounded to whole multiples of 2**-20 before they are added: sums are exact, so
neither the partitioning nor a task that runs twice changes a model.

Three ways to grow a tree: level by level to a depth; leaf by leaf, best gain first, to a number
of leaves; symmetric, with one split for all nodes of a level.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path, ensure_checkpoint_dir, materialise, scratch_path

BINS = 32                     # values of a quantised feature; 0 is a missing value
UNIT = 1 << 20                # gradients are whole multiples of 1 / UNIT
PACKED = float(1 << 35)       # one row, beside a sum of second derivatives: each is at most UNIT / 4
PAIRED_BINS = 64              # up to so many bins two features are counted in one table
BLOCK_ROWS = 8192             # rows of a stored block, fewer than twice as many
WORK_ROWS = 65536             # blocks of a task are joined to so many rows, a block more at most; sums of packed numbers stay whole below 2**17
ROWS_PER_TASK = 1_000_000
PAIRS_PER_TASK = 1 << 20      # (fit, row) pairs below which a further task costs more than it saves
FAN_IN = 64                   # partial histograms that the driver adds; more are first added in tasks
QUANTILE_ACCURACY = 10_000
SEED = 42


@dataclass(frozen=True)
class Learner:
    name: str
    growth: str = "level"         # "level" and "symmetric" to ``depth``, "leaf" to ``leaves``
    depth: int = 4
    leaves: int = 20
    rounds: int = 200
    rate: float = 0.03
    rows: float = 1.0             # share of the rows drawn for each tree
    columns: float = 1.0          # share of the features drawn for each tree
    l2: float = 1.0
    least_hessian: float = 1e-3   # second derivative that each side of a split needs
    least_rows: int = 1


class Fit(NamedTuple):
    """One learner on the rows outside one fold; ``fold`` -1 holds out nothing."""

    learner: Learner
    fold: int


class Node(NamedTuple):
    """A node of a fitted tree; leaves have ``left`` 0 and a value. Missing values go left."""

    feature: int
    threshold: float              # values up to it go left
    left: int
    right: int
    value: float
    rows: int


@dataclass
class Boosted:
    """A fitted model: start score (log-odds) and trees of nodes, node 0 the root."""

    name: str
    features: list[str]
    start: float
    trees: list[list[Node]]

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the rows of the matrix ``x`` (rows x features)."""
        out = np.full(len(x), self.start)
        edges, trees = self.coded()
        for i in range(0, len(x), WORK_ROWS):
            part = x[i:i + WORK_ROWS]
            codes = [coded(part[:, f], e) for f, e in enumerate(edges)]
            for shape, number, values in trees:
                out[i:i + WORK_ROWS] += values[lying(shape, number, codes, len(part))]
        return out

    def coded(self) -> tuple[list[np.ndarray], list[tuple]]:
        """(thresholds of every feature, (shape, leaf numbers, leaf values) of every tree) for rows whose values are replaced
        by the number of thresholds below them."""
        if not hasattr(self, "_coded"):
            edges: list[set] = [set() for _ in self.features]
            for n in (n for t in self.trees for n in t if n.left):
                edges[n.feature].add(n.threshold)
            rising = [np.array(sorted(e), float) for e in edges]
            at = [{v: k for k, v in enumerate(e.tolist())} for e in rising]
            trees = []
            for t in self.trees:
                leaves = [i for i, n in enumerate(t) if not n.left]
                trees.append(([(n.feature, at[n.feature][n.threshold], n.left, n.right) if n.left else (0, 0, 0, 0) for n in t],
                              numbered(len(t), leaves), np.array([0.0, *[t[i].value for i in leaves]])))
            self._coded = rising, trees
        return self._coded

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}


def coded(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Number of ``edges`` below each value, 0 for a missing one: a value is above edge k where its code is above k."""
    at = np.where(np.isnan(values), 0, np.searchsorted(edges, values, "left"))
    return at.astype(np.uint8 if len(edges) < 256 else np.int32)


def numbered(n_nodes: int, wanted: Sequence[int]) -> list[int]:
    """1 + the place in ``wanted`` of each node; 0 for the others."""
    out = [0] * n_nodes
    for k, n in enumerate(wanted, 1):
        out[n] = k
    return out


def lying(shape: Sequence[tuple[int, int, int, int]], number: Sequence[int], x: Sequence[np.ndarray], n_rows: int) -> np.ndarray:
    """The number of the numbered node that each row lies in, 0 where in none; numbered nodes hold no other.

    ``shape`` is (feature, code, left, right) of each node, children behind their parents; codes of ``x`` up to
    ``code`` go left, ``left`` 0 marks a leaf.
    """
    needed = [k > 0 for k in number]
    for i in range(len(shape) - 1, -1, -1):
        _, _, left, right = shape[i]
        if left and (needed[left] or needed[right]):
            needed[i] = True
    kind = np.uint8 if max(number) < 256 else np.uint16 if max(number) < 65536 else np.int32
    out = np.zeros(n_rows, kind)
    todo: list[tuple[int, np.ndarray | None]] = [(0, None)]
    while todo:
        i, rows = todo.pop()
        if number[i]:
            if rows is None:
                out[:] = number[i]
            else:
                out += rows.view(np.uint8) * kind(number[i])
            continue
        feature, code, left, right = shape[i]
        if not left or not needed[i]:
            continue
        below = x[feature] <= code
        if needed[left]:
            todo.append((left, below if rows is None else rows & below))
        if needed[right]:
            todo.append((right, ~below if rows is None else rows > below))
    return out


# ------------------------------------------------------------------ quantised blocks

def cut_points(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Rising cut points of every feature at even quantiles, from one aggregate of mergeable summaries."""
    probs = F.array(*[F.lit(k / (bins - 1)) for k in range(1, bins - 1)])
    row = df.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), probs, QUANTILE_ACCURACY)
                   .alias(f"q{i}") for i, c in enumerate(features)]).collect()[0]
    return [np.unique(np.array(row[f"q{i}"] or [], float)) for i in range(len(features))]


def quantised(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """1 + number of cuts below each value; 0 for a missing one."""
    return np.where(np.isnan(values), 0, 1 + np.searchsorted(cuts, values, "left")).astype(np.uint8)


def blocks(df: DataFrame, key: str, label: str, features: Sequence[str], fold: str | None, cuts: list[np.ndarray]) -> DataFrame:
    """Rows gathered into blocks: (n, x, y, fold, u) as packed bytes, x feature by feature; stored."""
    names = [f"x{i}" for i in range(len(features))]
    cols = df.select(F.col(label).cast("int").alias("y"), (F.col(fold) if fold else F.lit(-2)).cast("int").alias("fold"),
                     F.xxhash64(key).alias("u"), *[F.col(c).cast("double").alias(n) for c, n in zip(features, names)])

    def packed(table: pa.Table) -> pa.RecordBatch:
        x = [quantised(table.column(n).to_numpy(), c) for n, c in zip(names, cuts)]
        own = [np.concatenate(x).tobytes() if x else b""] + [
            table.column(c).to_numpy().astype(t).tobytes() for c, t in (("y", "u1"), ("fold", "i2"), ("u", "i8"))]
        return pa.RecordBatch.from_arrays([pa.array([table.num_rows], pa.int32()), *[pa.array([b], pa.binary()) for b in own]],
                                          ["n", "x", "y", "fold", "u"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                held.append(batch.slice(i, BLOCK_ROWS))
                n += held[-1].num_rows
                if n >= BLOCK_ROWS:
                    yield packed(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield packed(pa.Table.from_batches(held))

    return materialise(cols.mapInArrow(run, "n int, x binary, y binary, fold binary, u binary"), "boosting-blocks")


class Block(NamedTuple):
    x: np.ndarray                 # features x rows
    y: np.ndarray
    fold: np.ndarray
    u: np.ndarray
    margins: np.ndarray           # fits x rows


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: each output bit depends on all input bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def drawn(u: np.ndarray, name: str, tree: int, share: float) -> np.ndarray:
    """The rows that a learner's tree is grown on: by a hash of the row's key, the learner and the tree."""
    salt = np.uint64(int.from_bytes(f"{name}:{tree}".encode()[-8:].rjust(8, b"\0"), "little") ^ (tree * 0x9E3779B97F4A7C15 % (1 << 64)))
    return (mixed(mixed(u.astype(np.uint64)) ^ salt) >> np.uint64(11)).astype(float) * 2.0 ** -53 < share


class Level(NamedTuple):
    """What a job needs of the growing trees, fit by fit: shape, numbers of the nodes to be counted, drawn features."""

    tree: int
    fits: list[int]
    shapes: list[list[tuple]]
    numbers: list[list[int]]
    columns: list[list[int]]


def histograms(block: Block, level: Level, fits: Sequence[Fit], bins: int) -> np.ndarray:
    """(gradient, second derivative, rows) x slots x features x bins of one block; slots in order of fits and numbers."""
    sizes = [max(n) for n in level.numbers]
    n_rows = len(block.y)
    out = np.zeros((3, sum(sizes), len(block.x), bins))
    ones = np.ones(bins)
    buffers = np.empty((2, n_rows)), np.empty(n_rows, np.intp), np.empty(n_rows, np.uint16)
    learned: dict[int, np.ndarray] = {}
    draws: dict[str, np.ndarray] = {}
    pairs: dict[tuple, np.ndarray] = {}
    first = 0
    for fit, shape, number, columns, size in zip(level.fits, level.shapes, level.numbers, level.columns, sizes):
        learner, fold = fits[fit]
        if fold not in learned:
            learned[fold] = block.fold != fold
        keep = learned[fold]
        if learner.rows < 1:
            if learner.name not in draws:
                draws[learner.name] = drawn(block.u, learner.name, level.tree, learner.rows)
            keep = keep & draws[learner.name]
        slot = lying(shape, number, block.x, n_rows)
        rows = np.flatnonzero(keep & (slot != 0))
        own = out[:, first:first + size]
        first += size
        n = len(rows)
        if not n:
            continue
        (g, packed), cell, code = (b[..., :n] for b in buffers)
        gradients(block.margins[fit].take(rows), block.y.take(rows), g, packed)
        step = 2 if bins <= PAIRED_BINS else 1
        at = slot.take(rows).astype(np.intp) - 1 if size > 1 else None
        for k in range(0, len(columns), step):
            group = tuple(columns[k:k + step])
            if group not in pairs:
                codes = block.x[group[0]].astype(np.uint16)
                pairs[group] = codes * np.uint16(bins) + block.x[group[1]] if len(group) == 2 else codes
            cells = bins ** len(group)
            pairs[group].take(rows, out=code, mode="clip")
            if at is None:
                cell[:] = code
            else:
                np.multiply(at, cells, out=cell)
                cell += code
            for weight, is_packed in ((g, False), (packed, True)):
                table = np.bincount(cell, weight, size * cells).reshape(size, *[bins] * len(group))
                for axis, f in enumerate(group, 1):
                    total = table if len(group) == 1 else table @ ones if axis == 1 else ones @ table
                    if is_packed:
                        own[2, :, f] = count = np.floor(total / PACKED)
                        own[1, :, f] = total - count * PACKED
                    else:
                        own[0, :, f] = total
    return out


def gradients(margins: np.ndarray, y: np.ndarray, g: np.ndarray, packed: np.ndarray) -> None:
    """Gradients into ``g``, second derivatives beside one row each into ``packed``; all whole numbers."""
    p = g
    np.negative(margins, out=p, dtype=float, casting="unsafe")
    np.exp(p, out=p)
    p += 1
    np.divide(1, p, out=p)
    np.subtract(1, p, out=packed)
    packed *= p
    packed *= UNIT
    np.rint(packed, out=packed)
    packed += PACKED
    p -= y
    p *= UNIT
    np.rint(p, out=p)


# ------------------------------------------------------------------ growing

class Growing:
    """One tree of one fit while it grows. A split that is not ``taken`` was only tried."""

    def __init__(self, fit: Fit, tree: int, n_features: int):
        self.learner = fit.learner
        self.feature, self.cut, self.left, self.right, self.deep = [0], [0], [0], [0], [0]
        self.hist: list[np.ndarray | None] = [None]
        self.total: list[np.ndarray | None] = [None]    # gradient, second derivative and rows of a node
        self.best: list[tuple] = [()]
        self.taken: list[bool] = [False]
        self.wanted = [0]                       # nodes whose histogram the next job counts
        self.pairs: list[tuple[int, int, int]] = []     # (parent, counted child, its sibling)
        n = max(1, round(self.learner.columns * n_features))
        draw = np.random.default_rng([SEED, tree, fit.fold + 1, *fit.learner.name.encode()])
        self.columns = np.isin(np.arange(n_features), draw.permutation(n_features)[:n])
        self.drawn = np.flatnonzero(self.columns).tolist()
        self.queue: list[tuple] = []
        self.leaves = 1

    def split(self, node: int, feature: int, cut: int, last: bool = False) -> None:
        """Children of ``node``; the one with fewer rows is to be counted, unless they are the ``last`` of the tree."""
        n = len(self.left)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, n, n + 1
        for _ in range(2):
            for column, empty in ((self.feature, 0), (self.cut, 0), (self.left, 0), (self.right, 0), (self.hist, None),
                                  (self.best, ()), (self.taken, False), (self.deep, self.deep[node] + 1), (self.total, None)):
                column.append(empty)
        own = self.hist[node][:, feature]
        self.total[n] = own[:, :cut + 1].sum(axis=1)
        self.total[n + 1] = own[:, cut + 1:].sum(axis=1)
        if last:
            return
        small = n if self.total[n][2] <= self.total[n + 1][2] else n + 1
        self.wanted.append(small)
        self.pairs.append((node, small, 2 * n + 1 - small))

    def fill(self, found: dict[int, np.ndarray]) -> list[int]:
        """Histograms of the wanted nodes and their siblings; returns the nodes that have one now."""
        for node, h in found.items():
            self.hist[node] = h
        if 0 in found:
            self.total[0] = found[0][:, self.drawn[0]].sum(axis=1)
        for parent, one, other in self.pairs:
            self.hist[other] = self.hist[parent] - self.hist[one]
        new = list(found) + [other for _, _, other in self.pairs]
        self.wanted, self.pairs = [], []
        return sorted(new)

    def grow(self, new: list[int], gains: list[np.ndarray], parts: list[np.ndarray]) -> None:
        """Next splits, given the new nodes' gains (features x cuts); wants nothing when the tree is done."""
        for node, gain in zip(new, gains):
            at = int(np.argmax(gain))
            self.best[node] = (float(gain.ravel()[at]), *divmod(at, gain.shape[1]))
        if self.learner.growth == "leaf":
            return self.grow_best(new)
        level = [n for n in new if self.deep[n] < self.learner.depth]
        last = bool(level) and self.deep[level[0]] + 1 == self.learner.depth
        if self.learner.growth == "symmetric":
            if level:
                total = sum(parts[new.index(n)] for n in level)      # -inf where no node of the level may be split
                at = int(np.argmax(total))
                if total.ravel()[at] > 0:
                    for n in level:
                        self.taken[n] = True
                        self.split(n, *divmod(at, total.shape[1]), last)
            return None
        for n in level:
            gain, feature, cut = self.best[n]
            if gain > 0:
                self.taken[n] = True
                self.split(n, feature, cut, last)
        return None

    def grow_best(self, new: list[int]) -> None:
        """Best gain first. Takes splits while the children of the next one are known; then tries every split that
        would be taken if children not yet known had no gain, so that a tree needs about as many jobs as it is deep.
        The split that makes the last leaf is taken without knowing its children, and never only tried."""
        if 0 in new:
            self.queue.append((-self.best[0][0], 0))
        queue, leaves, known = list(self.queue), self.leaves, True
        while queue and leaves < self.learner.leaves and queue[0][0] < 0:
            _, n = heapq.heappop(queue)
            leaves += 1
            if leaves == self.learner.leaves:
                if known:
                    if not self.left[n]:
                        self.split(n, *self.best[n][1:], last=True)
                    self.taken[n], self.queue, self.leaves = True, [], leaves
                break
            if not self.left[n]:
                known = False
                self.split(n, *self.best[n][1:])
                continue
            if self.hist[self.left[n]] is None:
                continue
            for child in (self.left[n], self.right[n]):
                heapq.heappush(queue, (-self.best[child][0], child))
            if known:
                self.taken[n], self.queue, self.leaves = True, list(queue), leaves

    def nodes(self, cuts: list[np.ndarray]) -> tuple[list[Node], list[tuple]]:
        """The finished tree, and (feature, cut, left, right, value) of its nodes in quantised form."""
        number, order = {0: 0}, [0]
        for n in order:
            if self.taken[n]:
                for child in (self.left[n], self.right[n]):
                    number[child] = len(order)
                    order.append(child)
        out, packed = [], []
        for n in order:
            g, h, rows = self.total[n]
            if self.taken[n]:
                f, c = self.feature[n], self.cut[n]
                edge = float(cuts[f][c - 1]) if c else -np.inf          # cut 0: only missing values go left
                out.append(Node(f, edge, number[self.left[n]], number[self.right[n]], 0.0, int(rows)))
                packed.append((f, c, number[self.left[n]], number[self.right[n]], 0.0))
            else:
                value = -self.learner.rate * (g / UNIT) / max(h / UNIT + self.learner.l2, 1e-9) if rows else 0.0
                out.append(Node(0, 0.0, 0, 0, float(value), int(rows)))
                packed.append((0, 0, 0, 0, float(value)))
        return out, packed


def split_gains(hist: np.ndarray, l2: np.ndarray, least_hessian: np.ndarray, least_rows: np.ndarray,
                columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gains where a split is allowed, else -inf; gains with 0 where one side is empty) of nodes x features x cuts."""
    left = np.cumsum(hist, axis=3)[..., :-1]
    total = hist.sum(axis=3)[..., None]
    right = total - left
    reg = l2[:, None, None]

    def score(part: np.ndarray) -> np.ndarray:
        return (part[:, 0] / UNIT) ** 2 / np.maximum(part[:, 1] / UNIT + reg, 1e-9)
    gain = score(left) + score(right) - score(total)
    both = (left[:, 2] > 0) & (right[:, 2] > 0)
    allowed = both & columns[:, :, None]
    symmetric = np.where(columns[:, :, None], np.where(both, gain, 0.0), -np.inf)
    for part in (left, right):
        allowed &= (part[:, 1] / UNIT >= least_hessian[:, None, None]) & (part[:, 2] >= least_rows[:, None, None])
    return np.where(allowed, gain, -np.inf), symmetric


def added(rdd, count) -> np.ndarray:
    """Sum of one array per partition. Arrays hold whole numbers, so the order of adding is free."""
    def run(items):
        total = None
        for item in items:
            own = count(item)
            total = own if total is None else total + own
        if total is not None:
            yield total.astype(np.int64)
    parts = rdd.mapPartitions(run)
    n = rdd.getNumPartitions()
    if n > FAN_IN:
        return parts.treeReduce(lambda a, b: a + b, 2 if n <= FAN_IN ** 2 else 3)
    return sum(parts.collect())


def fit_all(df: DataFrame, key: str, label: str, features: Sequence[str], fits: Sequence[Fit], fold: str | None = None,
            bins: int = BINS) -> list[Boosted]:
    """Every fit on the rows of ``df`` outside its fold, in one sequence of jobs.

    Labels are 0 and 1; null or NaN features count as missing and go left. Without rows of both labels
    a fit has its start score alone. Jobs a round: the deepest tree's levels, whatever the number of fits.
    """
    features = list(features)
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    cuts = cut_points(df, features, bins)
    table = blocks(df, key, label, features, fold, cuts)
    folds = sorted({f.fold for f in fits})

    def sizes(row):
        y, own = np.frombuffer(row.y, "u1"), np.frombuffer(row.fold, "<i2")
        return np.array([[(own != f).sum(), y[own != f].sum()] for f in folds])
    source = table.rdd
    counts = added(source, sizes) if source.getNumPartitions() else 0
    counts = counts if isinstance(counts, np.ndarray) else np.zeros((len(folds), 2))
    n_rows = int(counts[:, 0].max(initial=0))
    start = []
    for f in fits:
        n, pos = (float(v) for v in counts[folds.index(f.fold)])
        start.append(float(np.log(pos / (n - pos))) if 0 < pos < n else (0.0 if n == 0 else (20.0 if pos else -20.0)))
    live = [i for i, f in enumerate(fits) if abs(start[i]) < 20 and counts[folds.index(f.fold)][0] > 0]
    trees: list[list[list[Node]]] = [[] for _ in fits]
    # leaf-wise trees are deeper: their jobs run beside those of the others, which need not wait for them
    groups = [g for g in ([i for i in live if (fits[i].learner.growth == "leaf") == leaf] for leaf in (True, False)) if g]
    if features and groups:
        rows = store_rows(spark, source, n_rows, len(live), len(features))
        try:
            for own, grown in zip(groups, _side_by_side([lambda g=g: _grow(
                    spark, rows, [fits[i] for i in g], [start[i] for i in g], cuts, bins) for g in groups])):
                for i, t in zip(own, grown):
                    trees[i] = t
        finally:
            delete_path(spark, rows.path)
    return [Boosted(f.learner.name, features, s, t) for f, s, t in zip(fits, start, trees)]


# ------------------------------------------------------------------ blocks in the shared folder

class Rows(NamedTuple):
    """Stored blocks: ``sizes[p]`` are the rows of each block of task p."""

    path: str
    n_features: int
    sizes: list[list[int]]


def write_file(path: str, *parts: np.ndarray) -> None:
    """One file of the parts' bytes, there as a whole or not at all; a task that runs twice writes the same again."""
    store, place = pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    store.create_dir(place.rpartition("/")[0])
    own = f"{place}-{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        for a in parts:
            out.write(np.ascontiguousarray(a))
    store.move(own, place)


def read_file(path: str) -> pa.Buffer:
    """The file's bytes, mapped into memory where it is a local one."""
    store, place = pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    if isinstance(store, pafs.LocalFileSystem):
        return pa.memory_map(place).read_buffer()
    with store.open_input_file(place) as f:
        return f.read_buffer()


def store_rows(spark: SparkSession, source, n_rows: int, n_fits: int, n_features: int) -> Rows:
    """Write the blocks of ``source``, joined and dealt over the tasks, to the shared folder."""
    path = scratch_path(spark, f"boosting-rows-{uuid.uuid4().hex}")
    if ":" not in path.partition("/")[0]:
        path = f"file://{path}"
    slots = spark.sparkContext.defaultParallelism
    tasks = max(-(-n_rows // ROWS_PER_TASK), min(slots, -(-n_rows * n_fits // PAIRS_PER_TASK)), 1)
    tasks = -(-tasks // slots) * slots if tasks > slots else tasks

    def written(part: int, number: int, rows: list) -> int:
        x = np.concatenate([np.frombuffer(r.x, np.uint8).reshape(n_features, r.n) for r in rows], axis=1)
        y, fold, u = (np.concatenate([np.frombuffer(getattr(r, c), t) for r in rows]) for c, t in (("y", "u1"), ("fold", "<i2"), ("u", "<i8")))
        write_file(f"{path}/rows/{part}-{number}", u, fold, x, y)
        return len(y)

    def run(part: int, items: Iterator) -> Iterator[tuple[int, list[int]]]:
        sizes, held, n = [], [], 0
        for _, row in items:
            held.append(row)
            n += row.n
            if n >= WORK_ROWS:
                sizes.append(written(part, len(sizes), held))
                held, n = [], 0
        if held:
            sizes.append(written(part, len(sizes), held))
        yield part, sizes
    # dealt by number: RDD.repartition moves Python's batches of blocks whole and leaves most tasks empty
    dealt = source.zipWithIndex().map(lambda r: (r[1] % tasks, r[0])).partitionBy(tasks, int)
    return Rows(path, n_features, [sizes for _, sizes in sorted(dealt.mapPartitionsWithIndex(run).collect())])


def read_block(rows: Rows, part: int, number: int) -> Block:
    """One stored block, without scores."""
    n, f = rows.sizes[part][number], rows.n_features
    data = read_file(f"{rows.path}/rows/{part}-{number}")
    return Block(np.frombuffer(data, np.uint8, f * n, 10 * n).reshape(f, n), np.frombuffer(data, np.uint8, n, (10 + f) * n),
                 np.frombuffer(data, "<i2", n, 8 * n), np.frombuffer(data, "<i8", n), np.zeros((0, n), np.float32))


def _side_by_side(jobs: list) -> list:
    wrap = inheritable_thread_target(SparkSession.getActiveSession())
    with ThreadPoolExecutor(max_workers=max(1, len(jobs))) as pool:
        return list(pool.map(lambda job: wrap(job)(), jobs))


def _grow(spark: SparkSession, rows: Rows, fits: list[Fit], start: list[float], cuts: list[np.ndarray],
          bins: int) -> list[list[list[Node]]]:
    n_features, n_fits = len(cuts), len(fits)
    first = np.array(start, np.float32)
    place = f"{rows.path}/{uuid.uuid4().hex}"
    tasks = spark.sparkContext.parallelize(range(len(rows.sizes)), len(rows.sizes))

    def loaded(part: int, tree: int) -> Iterator[tuple[Block, str]]:
        """The task's blocks with their scores before ``tree``, and the name that their scores are kept under."""
        for number, n in enumerate(rows.sizes[part]):
            name = f"{part}-{number}"
            margins = (np.frombuffer(read_file(f"{place}/{tree}/{name}"), np.float32).reshape(n_fits, n) if tree
                       else np.repeat(first[:, None], n, axis=1))
            yield read_block(rows, part, number)._replace(margins=margins), name

    def advanced(part: int, tree: int, done: list[tuple]) -> Iterator[Block]:
        """Blocks with the scores before ``tree``, which are written: those before the last tree, and its leaves."""
        for b, name in loaded(part, tree - 1):
            margins = b.margins.copy()
            for i, shape, number, values in done:
                margins[i] += values.take(lying(shape, number, b.x, len(b.y)))
            write_file(f"{place}/{tree}/{name}", margins)
            yield b._replace(margins=margins)
    out: list[list[list[Node]]] = [[] for _ in fits]
    setting = {k: np.array([getattr(f.learner, k) for f in fits], float) for k in ("l2", "least_hessian", "least_rows")}
    last: list[tuple] = []
    for tree in range(max(f.learner.rounds for f in fits)):
        done = []
        for i, nodes in last:
            leaves = [k for k, n in enumerate(nodes) if not n[2]]
            done.append((i, [n[:4] for n in nodes], numbered(len(nodes), leaves),
                         np.array([0.0, *[nodes[k][4] for k in leaves]]).astype(np.float32)))
        kept = tasks.flatMap(lambda p, tree=tree: (b for b, _ in loaded(p, tree)))
        state = tasks.flatMap(lambda p, tree=tree, done=done: advanced(p, tree, done)) if tree else kept
        growing = {i: Growing(f, tree, n_features) for i, f in enumerate(fits) if tree < f.learner.rounds}
        while active := [i for i, g in growing.items() if g.wanted]:
            slots = [(i, n) for i in active for n in growing[i].wanted]
            level = Level(tree, active, [list(zip(g.feature, g.cut, g.left, g.right)) for g in (growing[i] for i in active)],
                          [numbered(len(growing[i].left), growing[i].wanted) for i in active], [growing[i].drawn for i in active])
            found = added(state, lambda b, level=level: histograms(b, level, fits, bins))
            if state is not kept:
                if tree > 1:
                    delete_path(spark, f"{place}/{tree - 1}")
                state = kept
            found = np.moveaxis(found, 0, 1)                      # slots x 3 x features x bins
            new, hist = [], []
            by_fit: dict[int, dict[int, np.ndarray]] = {}
            for k, (i, n) in enumerate(slots):
                by_fit.setdefault(i, {})[n] = found[k]
            for i, own in by_fit.items():
                nodes = growing[i].fill(own)
                new.append((i, nodes))
                hist += [growing[i].hist[n] for n in nodes]
            of = np.repeat([i for i, _ in new], [len(nodes) for _, nodes in new])
            columns = np.array([growing[i].columns for i in of])
            gains, parts = split_gains(np.array(hist), setting["l2"][of], setting["least_hessian"][of], setting["least_rows"][of], columns)
            at = 0
            for i, nodes in new:
                growing[i].grow(nodes, list(gains[at:at + len(nodes)]), list(parts[at:at + len(nodes)]))
                at += len(nodes)
        last = []
        for i, g in growing.items():
            nodes, packed = g.nodes(cuts)
            out[i].append(nodes)
            last.append((i, packed))
    return out


# ------------------------------------------------------------------ scores and tables

def with_probabilities(df: DataFrame, models: Sequence[Boosted], names: Sequence[str]) -> DataFrame:
    """``df`` with one probability column per model, from one Arrow pass over the feature columns."""
    models = list(models)
    if not models:
        return df
    features = models[0].features

    @F.pandas_udf(", ".join(f"m{i} double" for i in range(len(models))))
    def score(x):
        import pandas as pd

        values = x.to_numpy(float)
        return pd.DataFrame({f"m{i}": 1 / (1 + np.exp(-m.margins(values))) for i, m in enumerate(models)})

    packed = F.struct(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]) if features else F.struct(F.lit(0.0))
    scored = df.withColumn("_boosted", score(packed))
    return scored.select(*df.columns, *[F.col(f"_boosted.m{i}").alias(n) for i, n in enumerate(names)])


NODE_SCHEMA = ("model string, tree int, node int, feature string, threshold double, `left` int, `right` int, "
               "value double, rows long")


def node_table(spark: SparkSession, models: Sequence[Boosted]) -> DataFrame:
    """One row per node of every tree; ``left`` 0 marks a leaf, a tree's start score is in tree -1."""
    rows = []
    for m in models:
        rows.append((m.name, -1, 0, None, None, 0, 0, m.start, 0))
        for t, nodes in enumerate(m.trees):
            rows += [(m.name, t, i, m.features[n.feature] if n.left else None, n.threshold if n.left else None,
                      n.left, n.right, n.value, n.rows) for i, n in enumerate(nodes)]
    return spark.createDataFrame(rows, NODE_SCHEMA)


def from_node_table(table: DataFrame, features: Sequence[str]) -> list[Boosted]:
    """Models again; their size is that of the trees, not of any data."""
    number = {f: i for i, f in enumerate(features)}
    found: dict[str, Boosted] = {}
    for r in table.orderBy("model", "tree", "node").collect():
        if r["tree"] < 0:
            found[r["model"]] = Boosted(r["model"], list(features), r["value"], [])
            continue
        trees = found[r["model"]].trees
        if r["node"] == 0:
            trees.append([])
        trees[-1].append(Node(number.get(r["feature"], 0), r["threshold"] if r["left"] else 0.0, r["left"], r["right"], r["value"], r["rows"]))
    return list(found.values())
