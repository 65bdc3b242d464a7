import random

import numpy as np
import pytest

from cohortlab.llm import suffix_dedup as s

from .conftest import prose
from .test_suffix_dedup import check


def passages(spark, n):
    """One passage between different words in every text, some at the start or end, with equal and missing ids."""
    rnd = random.Random(31)
    passage = prose(rnd, 70)
    rows = [(i % (n - 3) if i % 11 else None, prose(rnd, rnd.randint(0, 30)) + passage[rnd.randint(0, 9):] + prose(rnd, rnd.randint(0, 30)))
            for i in range(n)]
    return spark.createDataFrame([*rows, (n, "a" * 400), (n + 1, "a" * 250), (n + 2, None)], "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("held", [1 << 20, 300])
def test_windows_of_frequent_anchors(spark, monkeypatch, held):
    for name, value in (("FAMILY", 8), ("COUNTED_FROM", 1), ("RUN_BYTES", 2000), ("WINDOWS_HELD", held), ("WINDOW_BYTES", 4000)):
        monkeypatch.setattr(s, name, value)
    df = passages(spark, 60)
    frequent, places = s.frequent_anchors(s.keyed(df))
    assert len(frequent) and places > 8 * len(frequent)
    check(df)


def test_no_family_goes_to_one_range(spark, monkeypatch):
    """The contexts that a range merges of one anchor stay under the bound, however many texts hold the passage."""
    for name, value in (("FAMILY", 8), ("COUNTED_FROM", 1)):
        monkeypatch.setattr(s, name, value)
    met, ranges = [], []
    frame, merged = type(spark.range(1)), s.merged
    real = frame.mapInArrow

    def spy(self, func, schema, *rest, **more):
        out = real(self, func, schema, *rest, **more)
        if "blob" in str(schema):
            met.append(out)
        return out

    monkeypatch.setattr(frame, "mapInArrow", spy)
    monkeypatch.setattr(s, "merged", lambda n: ranges.append(n) or merged(n))
    s.repeated_bytes(passages(spark, 60))
    families = {}
    for r in met[0].filter("key is null").filter(f"part < {ranges[0]}").collect():
        for x in s.decode(bytes(r.blob))[0]:
            families[x[:s.GRAM]] = families.get(x[:s.GRAM], 0) + 1
    assert max(families.values(), default=0) <= 8


def test_windows_round_trip():
    docs = [(None, b"k" * 16), (-4, b"l" * 16)]
    a = np.array([1, 2, 3], np.uint64)
    f, w, d, p, names = s.unpack_windows(s.pack_windows(a, a + s.U(7), np.array([1, 0, 1]), np.array([5, 6, 7]), docs))
    assert (f.tolist(), w.tolist(), p.tolist()) == ([1, 2, 3], [8, 9, 10], [5, 6, 7])
    assert [names[x] for x in d] == [((1, -4), b"l" * 16), ((0, 0), b"k" * 16), ((1, -4), b"l" * 16)]
