import random

import pytest

EXTRA = ["key", "score", "rank", "n", "_row", "spans", "component", "word", "kept", "part", "k", "at", "ids", "held_out", "rep",
         "_key", "_first", "_kept", "_new", "_nth", "_class", "_rank"]


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 7))) for _ in range(n))


def edge_rows():
    """(doc_id, text): nulls, empty and long texts, ties, repeated rows and ids, odd characters, shared passages."""
    rnd = random.Random(12)
    base = prose(rnd, 160)
    words = base.split(" ")
    near = list(words)
    near[70] = "changed"
    passage = prose(rnd, 55)
    return [
        (0, base), (1, base), (2, " ".join(near)), (3, base.upper()), (4, prose(rnd, 80) + " " + passage + " " + prose(rnd, 70)),
        (5, prose(rnd, 60) + " " + passage), (6, None), (7, ""), (8, "   \n\t "), (9, "one two three"), (10, "One TWO  three"),
        (11, "a" * 99), (12, "a" * 100), (13, "a" * 300), (14, "é" * 120), (15, "x " * 400), (16, "line here again\n" * 30),
        (17, "The MIT License and mit license; Apache-License, GNU General Public License.\n" + prose(rnd, 60)),
        (18, "it's  we'll I'VE ''s '\n\n x　y ٣٤ 漢字 <|endoftext|> #*$%&|<> \x1c é"),
        (19, prose(rnd, 4000)), (20, " ".join(words[:100]) + " " + prose(rnd, 20)), (21, "\n" * 150), (22, base), (22, base), (23, "x"),
        (23, prose(rnd, 70)), (None, base), (None, None), (None, prose(rnd, 60)), (-5, passage), (2**40, "b" * 260 + passage),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    """The rows above with columns whose names the operators use inside."""
    rows = [(i, t, "en", "s", len(t or ""), *["0"] * len(EXTRA)) for i, t in edge_rows()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.filter("1 = 0")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def same(got, expected):
    """Equal as multisets of rows."""
    got, expected = sorted(map(repr, got)), sorted(map(repr, expected))
    assert len(got) == len(expected)
    assert [(g, e) for g, e in zip(got, expected) if g != e][:3] == []


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
