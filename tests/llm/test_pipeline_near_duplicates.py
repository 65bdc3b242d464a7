import itertools
import random

import corpus_pipeline as pipeline

from . import brute
from .conftest import prose, rows_of, same


def kept(rows, k=5, percent=80):
    """Ids that stay: the smallest of each component of 5-word sets of similarity 0.8."""
    sets = {i: brute.shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, s), (j, t) in itertools.combinations(sets.items(), 2):
        both = len(s & t)
        if s and t and 100 * both >= percent * (len(s) + len(t) - both):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return {i for i in sets if root(i) == i}


def test_copies_between_80_and_85_go(spark):
    """One replaced block (similarity about 0.82 of both four and five words) and scattered edits."""
    rnd = random.Random(21)
    rows = []
    for i in range(0, 60, 3):
        w = prose(rnd, 200).split(" ")
        block, edits = list(w), list(w)
        n = rnd.randint(10, 22)
        block[90:90 + n] = prose(rnd, n).split(" ")
        for at in rnd.sample(range(10, 190, 10), rnd.randint(2, 5)):
            edits[at] = f"new{at}"
        rows += [(i, " ".join(w)), (i + 1, " ".join(block)), (i + 2, " ".join(edits))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows],
                               "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = kept(rows)
    assert want < kept(rows, 4, 85)                  # some copies lie in the band
    same([i for i, _ in rows_of(pipeline.near_duplicate_stage(spark, df, ""))], want)


def test_rows_without_an_id_use_the_same_shingles(spark):
    """Equal sets of five words, different sets of four: a b c d e has one of five and two of four."""
    rows = [(1, "a b c d e a b c d e a"), (None, "b c d e a b c d e a b c"), (None, "other words of its own here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert brute.shingles(rows[0][1], 5) == brute.shingles(rows[1][1], 5)
    same([t for _, t in rows_of(pipeline.near_duplicate_stage(spark, df, ""))], [rows[0][1], rows[2][1]])
