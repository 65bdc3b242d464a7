import random

from cohortlab.llm import jaccard_join as j
from cohortlab.llm.components import components

from . import brute
from .conftest import rows_of, same


def check(df):
    same([(r.doc_id, r.n_shingles, r.component_id) for r in j.near_duplicates(df).collect()], brute.components(rows_of(df)))


def test_edge_rows(edge):
    check(edge)


def test_empty(nothing):
    assert j.near_duplicates(nothing).collect() == []


def test_copies_around_the_threshold(spark, monkeypatch):
    """Many edited copies, so buckets and groups hold several components; frequent shingles are few and many."""
    rnd = random.Random(3)
    base = [rnd.choice("abcdefghijklmnopqrstuvwxyz") * rnd.randint(1, 3) for _ in range(120)]
    rows = []
    for i in range(120):
        w = list(base[:rnd.choice([5, 20, 40, 120])])
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = "z" + str(rnd.randint(0, 3))
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df)
    monkeypatch.setattr(j, "FREQUENT_FROM", 3)
    check(df)


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (101, 103), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def test_unnamed_rows(spark):
    rows = [(1, "a b c d e"), (None, "A b c d e"), (None, "other words of its own"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same([r.text for r in j.unnamed_alone(df).collect()], ["other words of its own", None])
