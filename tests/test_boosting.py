"""Side-by-side boosting against a plain trainer, growth rules, sampling, edge cases; Newton fits; isotonic blocks; attribution."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cohortlab.operators import attribution, boosting as bo, isotonic, newton


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    n = 900
    x = rng.normal(size=(n, 3))
    x[rng.random((n, 3)) < 0.05] = np.nan
    y = (np.nan_to_num(x[:, 0]) + np.nan_to_num(x[:, 1]) ** 2 + rng.normal(size=n) > 1).astype(int)
    rows = [(i, int(y[i]), int(i % 3), *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "k long, y int, fold int, a double, b double, c double").repartition(5)


FEATURES = ["a", "b", "c"]


def plain_trees(x, y, cuts, learner):
    """Reference trainer: whole histograms of one fit, level by level, with the same rounding of gradients."""
    bins = np.stack([bo.quantised(x[:, f], cuts[f]) for f in range(x.shape[1])], axis=1)
    margin = np.full(len(y), np.log(y.sum() / (len(y) - y.sum())), np.float32)
    out = []
    for _ in range(learner.rounds):
        p = 1 / (1 + np.exp(-margin.astype(float)))
        g, h = np.rint((p - y) * bo.UNIT), np.rint(p * (1 - p) * bo.UNIT)

        def grow(rows, depth):
            def score(r):
                return (g[r].sum() / bo.UNIT) ** 2 / max(h[r].sum() / bo.UNIT + learner.l2, 1e-9)
            best = (0.0, None)
            if depth:
                for f in range(x.shape[1]):
                    for c in range(bo.BINS - 1):
                        left = bins[rows, f] <= c
                        a, b = rows[left], rows[~left]
                        if min(len(a), len(b)) < max(1, learner.least_rows) or min(h[a].sum(), h[b].sum()) / bo.UNIT < learner.least_hessian:
                            continue
                        gain = score(a) + score(b) - score(rows)
                        if gain > best[0] + 1e-12:
                            best = (gain, f, c)
            if best[1] is None:
                return [(rows, -learner.rate * (g[rows].sum() / bo.UNIT) / max(h[rows].sum() / bo.UNIT + learner.l2, 1e-9))]
            left = bins[rows, best[1]] <= best[2]
            return grow(rows[left], depth - 1) + grow(rows[~left], depth - 1)
        leaves = grow(np.arange(len(y)), learner.depth)
        for rows, value in leaves:
            margin[rows] += np.float32(value)
        out.append(sorted((len(r), round(float(v), 9)) for r, v in leaves))
    return out


def matrix(df):
    rows = df.orderBy("k").collect()
    return np.array([[np.nan if r[c] is None else r[c] for c in FEATURES] for r in rows]), np.array([r.y for r in rows]), np.array([r.fold for r in rows])


def test_level_trees_equal_a_plain_trainer(table):
    learner = bo.Learner("plain", "level", depth=3, rounds=4, rate=0.3)
    fits = [bo.Fit(learner, f) for f in (-1, 0, 2)]
    found = bo.fit_all(table, "k", "y", FEATURES, fits, "fold")
    x, y, fold = matrix(table)
    cuts = bo.cut_points(table, FEATURES)
    for fit, model in zip(fits, found):
        own = fold != fit.fold
        want = plain_trees(x[own], y[own], cuts, learner)
        got = [sorted((n.rows, round(n.value, 9)) for n in tree if not n.left) for tree in model.trees]
        assert got == want


def test_growth_rules(table):
    leaf = bo.Learner("leaf", "leaf", leaves=11, rounds=5, rate=0.2, least_rows=20, l2=0.0)
    sym = bo.Learner("sym", "symmetric", depth=3, rounds=5, rate=0.2, l2=3.0)
    one, two = bo.fit_all(table, "k", "y", FEATURES, [bo.Fit(leaf, -1), bo.Fit(sym, -1)])
    for tree in one.trees:
        leaves = [n for n in tree if not n.left]
        assert len(leaves) <= 11 and all(n.rows >= 20 for n in leaves) and sum(n.rows for n in leaves) == 900
    assert max(sum(not n.left for n in t) for t in one.trees) == 11
    for tree in two.trees:
        level = {0: [0]}
        for d in range(3):
            splits = {(tree[n].feature, tree[n].threshold) for n in level[d] if tree[n].left}
            assert len(splits) == 1
            level[d + 1] = [c for n in level[d] for c in (tree[n].left, tree[n].right)]


def gains_in_order(tree, learner, x, y, margin):
    """Best-first order check: gain of every split of a leaf-wise tree, from the rows."""
    p = 1 / (1 + np.exp(-margin))
    g, h = p - y, p * (1 - p)
    rows, out = {0: np.arange(len(y))}, {}
    for i, n in enumerate(tree):
        if n.left:
            left = ~(x[rows[i], n.feature] > n.threshold)
            rows[n.left], rows[n.right] = rows[i][left], rows[i][~left]

            def s(r):
                return g[r].sum() ** 2 / (h[r].sum() + learner.l2)
            out[i] = s(rows[n.left]) + s(rows[n.right]) - s(rows[i])
    return out


def test_leaf_wise_takes_the_best_gain_first(table):
    """A tree of few leaves is the beginning of one of more: same splits, and none left out has a larger gain."""
    few = bo.Learner("leaf", "leaf", leaves=5, rounds=1, l2=1.0)
    more = bo.Learner("leaf", "leaf", leaves=9, rounds=1, l2=1.0)
    small, = bo.fit_all(table, "k", "y", FEATURES, [bo.Fit(few, -1)])
    large, = bo.fit_all(table, "k", "y", FEATURES, [bo.Fit(more, -1)])
    x, y, _ = matrix(table)
    margin = np.full(len(y), small.start)
    a, b = gains_in_order(small.trees[0], few, x, y, margin), gains_in_order(large.trees[0], more, x, y, margin)
    taken = sorted(round(v, 3) for v in a.values())
    assert len(a) == 4 and len(b) == 8
    every = sorted((round(v, 3) for v in b.values()), reverse=True)
    assert all(any(abs(v - w) < 0.02 for w in every) for v in taken)


def test_partitioning_does_not_matter(table):
    learners = [bo.Learner("s", "level", depth=2, rounds=3, rows=0.7, columns=0.7), bo.Learner("l", "leaf", leaves=6, rounds=3)]
    fits = [bo.Fit(s, f) for s in learners for f in (-1, 1)]
    one = bo.fit_all(table, "k", "y", FEATURES, fits, "fold")
    two = bo.fit_all(table.coalesce(1), "k", "y", FEATURES, fits, "fold")
    assert [m.trees for m in one] == [m.trees for m in two]
    alone = bo.fit_all(table, "k", "y", FEATURES, fits[:1], "fold")        # nor who grows beside it
    assert alone[0].trees == one[0].trees
    assert 0.6 < one[0].trees[0][0].rows / 900 < 0.8                         # rows drawn


def test_many_partitions_add_in_tasks(table, monkeypatch):
    fit = [bo.Fit(bo.Learner("s", "level", depth=2, rounds=2), -1)]
    want = bo.fit_all(table, "k", "y", FEATURES, fit)
    monkeypatch.setattr(bo, "FAN_IN", 2)
    monkeypatch.setattr(bo, "BLOCK_ROWS", 100)
    monkeypatch.setattr(bo, "ROWS_PER_TASK", 100)
    assert bo.fit_all(table, "k", "y", FEATURES, fit)[0].trees == want[0].trees


def test_blocks_are_dealt_over_all_tasks(table, monkeypatch):
    """Many blocks in one stored partition still keep every task busy; the last children of a tree need no job."""
    monkeypatch.setattr(bo, "BLOCK_ROWS", 20)
    monkeypatch.setattr(bo, "WORK_ROWS", 100)
    monkeypatch.setattr(bo, "ROWS_PER_TASK", 180)
    dealt, counted = [], bo.added

    def watched(rdd, count):
        dealt.append([sum(n) for n in rdd.map(lambda b: len(b.y)).glom().collect()] if hasattr(rdd.first(), "margins") else None)
        return counted(rdd, count)
    monkeypatch.setattr(bo, "added", watched)
    bo.fit_all(table.coalesce(1), "k", "y", FEATURES, [bo.Fit(bo.Learner("s", "level", depth=3, rounds=1), -1)])
    jobs = [d for d in dealt if d]
    assert len(jobs) == 3 and all(len(d) >= 5 and sum(d) == 900 and max(d) <= 240 for d in jobs)


def test_jobs_map_stored_rows_and_leave_nothing(table, spark, monkeypatch):
    """No job reads rows that Spark holds for Python: blocks and scores are files of the shared folder, deleted at the end."""
    import glob
    from cohortlab.session import ensure_checkpoint_dir
    root = ensure_checkpoint_dir(spark).replace("file:", "")
    held, kept, counted = [], [], bo.added

    def watched(rdd, count):
        found = counted(rdd, count)
        held.append(spark.sparkContext._jsc.getPersistentRDDs().size())
        kept.append(len(glob.glob(f"{root}/boosting-rows-*/*/*")))
        return found
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    monkeypatch.setattr(bo, "added", watched)
    monkeypatch.setattr(bo, "BLOCK_ROWS", 100)
    monkeypatch.setattr(bo, "WORK_ROWS", 200)
    bo.fit_all(table, "k", "y", FEATURES, [bo.Fit(bo.Learner("s", "level", depth=2, rounds=4), f) for f in (-1, 0)], "fold")
    assert set(held) == {before} and len(held) == 1 + 4 * 2 and max(kept) > 1
    assert not glob.glob(f"{root}/boosting-rows-*")


def test_gradients_are_whole_numbers_of_the_plain_formula():
    rng = np.random.default_rng(6)
    m, y = (rng.normal(size=5000) * 4).astype(np.float32), rng.integers(0, 2, 5000).astype(np.uint8)
    g, packed = np.empty(5000), np.empty(5000)
    bo.gradients(m, y, g, packed)
    p = 1 / (1 + np.exp(-m.astype(float)))
    assert np.array_equal(g, np.rint((p - y) * bo.UNIT)) and np.array_equal(packed, np.rint(p * (1 - p) * bo.UNIT) + bo.PACKED)


def test_largest_joined_block_keeps_its_sums_whole():
    """Rows of the largest second derivative, as many as a joined block may have: counts and sums stay apart."""
    n = bo.WORK_ROWS + 2 * bo.BLOCK_ROWS
    block = bo.Block(np.ones((1, n), np.uint8), np.zeros(n, np.uint8), np.zeros(n, np.int16), np.arange(n), np.zeros((1, n), np.float32))
    found = bo.histograms(block, bo.Level(0, [0], [[(0, 0, 0, 0)]], [[1]], [[0]]), [bo.Fit(bo.Learner("s"), -1)], bo.BINS)
    assert found[:, 0, 0, 1].tolist() == [n * bo.UNIT / 2, n * bo.UNIT / 4, n]


def test_edges(table, spark):
    fit = [bo.Fit(bo.Learner("s", "level", depth=2, rounds=2), -1)]
    for rows, start in (("y = 1", 20.0), ("y = 0", -20.0), ("y > 5", 0.0)):
        model, = bo.fit_all(table.filter(rows), "k", "y", FEATURES, fit)
        assert model.start == start and model.trees == []
    flat, = bo.fit_all(table.select("k", "y", F.lit(1.0).alias("a"), F.lit(None).cast("double").alias("b")), "k", "y", ["a", "b"], fit)
    assert all(len(t) == 1 and abs(t[0].value) < 1e-6 for t in flat.trees)


def test_missing_values_can_split(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0), None if i % 4 == 0 else float(i % 7)) for i in range(200)], "k long, y int, a double")
    model, = bo.fit_all(df, "k", "y", ["a"], [bo.Fit(bo.Learner("s", "level", depth=1, rounds=1), -1)])
    root = model.trees[0][0]
    assert root.threshold == -np.inf and model.trees[0][root.left].rows == 50
    m = model.margins(np.array([[np.nan], [0.0], [5.0]]))
    assert m[0] > m[1] == m[2]


def test_scores_and_node_table(table, spark):
    found = bo.fit_all(table, "k", "y", FEATURES, [bo.Fit(bo.Learner(n, g, depth=2, leaves=5, rounds=3), -1) for n, g in (("x", "level"), ("z", "leaf"))])
    back = bo.from_node_table(bo.node_table(spark, found), FEATURES)
    x, _, _ = matrix(table)
    for a, b in zip(found, back):
        assert a.name == b.name and np.allclose(a.margins(x), b.margins(x), atol=0)
    got = [(r.px, r.pz) for r in bo.with_probabilities(table, found, ["px", "pz"]).orderBy("k").collect()]
    want = np.stack([1 / (1 + np.exp(-m.margins(x))) for m in found], axis=1)
    assert np.allclose(got, want)


# ------------------------------------------------------------------ attribution

def shapley(tree, row, n_features):
    """All coalitions: a missing player's split is averaged by the rows of its children."""
    def value(i, known):
        n = tree[i]
        if not n.left:
            return n.value
        if n.feature in known:
            return value(n.right if row[n.feature] > n.threshold else n.left, known)
        if not n.rows:
            return 0.0
        return sum(tree[c].rows / n.rows * value(c, known) for c in (n.left, n.right))
    out = np.zeros(n_features)
    for f in range(n_features):
        others = [g for g in range(n_features) if g != f]
        for k in range(n_features):
            for s in itertools.combinations(others, k):
                w = math.factorial(k) * math.factorial(n_features - k - 1) / math.factorial(n_features)
                out[f] += w * (value(0, {*s, f}) - value(0, set(s)))
    return out


def test_tree_attribution_equals_all_coalitions(table):
    learners = [bo.Learner("x", "level", depth=3, rounds=2), bo.Learner("z", "leaf", leaves=9, rounds=2, l2=0.0), bo.Learner("s", "symmetric", depth=3, rounds=2)]
    found = bo.fit_all(table, "k", "y", FEATURES, [bo.Fit(s, -1) for s in learners])
    weights = [0.5, -1.5, 2.0]
    rows = {r.k: r for r in attribution.tree_attributions(table.limit(40), "k", found, weights).collect()}
    x, _, _ = matrix(table)
    for k, r in rows.items():
        want = sum(w * shapley(t, x[k], 3) for w, m in zip(weights, found) for t in m.trees)
        got = [c.contribution for c in r.contributions]
        assert np.allclose(got, want, atol=1e-10)
        assert abs(sum(got) - (r.score - r.expectation)) < 1e-9
        assert [t.feature for t in r.top] == [f for _, f in sorted((-abs(v), f) for v, f in zip(got, FEATURES))][:3]


# ------------------------------------------------------------------ Newton fits

def test_newton_agrees_with_separate_fits(table):
    df = table.dropna().cache()
    fits = [(0.1, None), (10.0, None), (1.0, 0), (1.0, 2)]
    found = newton.fit_many(df, FEATURES, "y", fits, "fold")
    for (c, held), model in zip(fits, found):
        own = df if held is None else df.filter(F.col("fold") != held)
        stats = own.agg(*[F.mean(x).alias(f"m{x}") for x in FEATURES], *[F.stddev_samp(x).alias(f"s{x}") for x in FEATURES],
                        F.count("y").alias("n"), F.sum("y").alias("p")).collect()[0]
        scaled = own.select("y", *[((F.col(x) - stats[f"m{x}"]) / stats[f"s{x}"]).alias(x) for x in FEATURES],
                            F.when(F.col("y") == 1, stats["n"] / (2 * stats["p"])).otherwise(stats["n"] / (2 * (stats["n"] - stats["p"]))).alias("w"))
        ml = LogisticRegression(labelCol="y", weightCol="w", regParam=1 / (c * stats["n"]), standardization=False, maxIter=500, tol=1e-12).fit(
            VectorAssembler(inputCols=FEATURES, outputCol="features").transform(scaled))
        assert np.allclose([*model.weights, model.intercept], [*ml.coefficients, ml.intercept], atol=1e-6)


def test_newton_edges(table, spark):
    one = table.filter("y = 1")
    m, = newton.fit_many(one, FEATURES, "y", [(1.0, None)])
    assert m.weights == [0, 0, 0] and m.intercept == 20.0
    none, = newton.fit_many(table.filter("y > 4"), FEATURES, "y", [(1.0, None)])
    assert none.weights == [0, 0, 0] and none.intercept == 0.0
    apart = spark.createDataFrame([(float(i), int(i >= 10)) for i in range(20)], "a double, y int")       # separable: stays finite
    m, = newton.fit_many(apart, ["a"], "y", [(1e6, None)], standardise=False, balanced=False)
    got = [r.p for r in apart.select(m.probability().alias("p")).collect()]
    assert np.isfinite(m.weights[0]) and max(got[:10]) < 0.5 < min(got[10:])


# ------------------------------------------------------------------ isotonic

def sequential(rows):
    """Pool adjacent violators one score at a time: (lo, hi, value)."""
    out = []
    for x in sorted({x for x, _ in rows}):
        own = [y for v, y in rows if v == x]
        out.append([x, x, sum(own), len(own)])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, hi, p, n = out.pop()
            out[-1][1:] = [hi, out[-1][2] + p, out[-1][3] + n]
    return [(lo, hi, p / n) for lo, hi, p, n in out]


@pytest.mark.parametrize("shape", ["noise", "falling", "rising", "waves"])
def test_isotonic_equals_sequential(spark, shape):
    rng = np.random.default_rng(8)
    x = np.round(rng.random(600), 3)
    chance = {"noise": x, "falling": 1 - x, "rising": (x > 0.5) * 1.0, "waves": 0.5 + 0.5 * np.sin(9 * x)}[shape]
    rows = [(float(a), int(b)) for a, b in zip(x, rng.random(600) < chance)]
    df = spark.createDataFrame(rows, "p double, y int")
    got = [(r.lo, r.hi, r.value) for r in isotonic.fit_blocks(df, "p", "y", n_buckets=5).orderBy("lo").collect()]
    assert got == sequential(rows)


def test_isotonic_folds_and_application(spark):
    rng = np.random.default_rng(3)
    rows = [(float(round(a, 3)), int(rng.random() < a), i % 3) for i, a in enumerate(rng.random(400))]
    df = spark.createDataFrame(rows, "p double, y int, fold int")
    few = isotonic.fit_steps(df, "p", "y", "fold", 3, n_buckets=4)
    many = isotonic.fit_steps(df, "p", "y", "fold", 3, n_buckets=4, carried=3)
    assert all(s.cells is None for s in few) and all(s.cells for s in many)
    new = spark.createDataFrame([(i, v) for i, v in enumerate([None, -1.0, 2.0, *np.linspace(0, 1, 200).tolist()])], "id int, p double")
    a = {r.id: (r.c0, r.c1, r.c2) for r in isotonic.apply_steps(new, few, "p", ["c0", "c1", "c2"]).collect()}
    b = {r.id: (r.c0, r.c1, r.c2) for r in isotonic.apply_steps(new, many, "p", ["c0", "c1", "c2"]).collect()}
    assert a.keys() == b.keys() and a[0] == b[0] == (None,) * 3
    for k in range(3):
        blocks = sequential([(p, y) for p, y, f in rows if f != k])
        xs, ys = [v for lo, hi, _ in blocks for v in (lo, hi)], [v for *_, v in blocks for _ in range(2)]
        for r in new.collect()[1:]:
            assert a[r.id][k] == pytest.approx(np.interp(r.p, xs, ys), abs=1e-12) == b[r.id][k]


def test_tables_of_neighbouring_leaves_equal_the_leaves_alone(monkeypatch):
    """Trees of many leaves over values on, between and beyond the thresholds, some missing, in tables of few cells and of many."""
    rng = np.random.default_rng(8)

    def grown(n_leaves):
        tree = [bo.Node(0, 0.0, 0, 0, 1.0, 1000)]
        while sum(not n.left for n in tree) < n_leaves:
            i = int(rng.choice([k for k, n in enumerate(tree) if not n.left and n.rows > 1]))
            rows = int(rng.integers(1, tree[i].rows))
            edge = -np.inf if rng.random() < 0.1 else float(rng.integers(0, 8))
            tree[i] = bo.Node(int(rng.integers(0, 4)), edge, len(tree), len(tree) + 1, 0.0, tree[i].rows)
            tree += [bo.Node(0, 0.0, 0, 0, float(rng.normal()), r) for r in (rows, tree[i].rows - rows)]
        return attribution.leaves_of(tree)
    models = [(0.7, [grown(20) for _ in range(5)]), (-1.3, [grown(8) for _ in range(5)])]
    x = rng.integers(-1, 9, (500, 4)) + rng.choice([0.0, 0.5], (500, 4))
    x[rng.random(x.shape) < 0.1] = np.nan
    want = np.zeros((4, 500))
    for weight, trees in models:
        for leaf in (leaf for t in trees for leaf in t if len(leaf.features)):
            attribution.add_leaf(want, weight, leaf, np.where(np.isnan(x), -np.inf, x).T)
    n_leaves = sum(len(t) for _, trees in models for t in trees)
    for cells in (1, 12, 100, 1024):
        monkeypatch.setattr(attribution, "TABLE_CELLS", cells)
        tables: dict = {}
        for part in (x[:300], x[300:]):
            got = attribution.contributions(models, part, tables)
            assert np.allclose(got, want.T[:300] if len(part) == 300 else want.T[300:], atol=1e-12)
    assert len(tables["cells"]) < n_leaves / 4
