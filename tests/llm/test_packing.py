import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as public
import pytest
from tokenizers import Tokenizer

from cohortlab.llm import packing as p

from .conftest import rows_of

PATH = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encode():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def check(df, encode):
    pieces = p.pack(df, PATH).collect()
    want = Counter_of((i, tuple(encode(t) + [1])) for i, t in rows_of(df))
    sequences = defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= p.WINDOW
        padding += (p.WINDOW - at) if at & (at - 1) else 0
    # the pieces of each document, its ids cut without gap
    by_doc = defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for doc_id in {i for i, _ in want}:
        expected = []
        for (i, ids), times in want.items():
            if i == doc_id:
                expected.append((ids, times))
        got = sorted(by_doc[doc_id])
        if len(expected) == 1 and expected[0][1] == 1:
            ids, at = np.array(expected[0][0], "<u4"), 0
            for start, length, crc, n in got:
                assert start == at and n == len(ids) and crc == zlib.crc32(ids[at:at + length])
                at += length
            assert at == len(ids)
        else:
            assert sum(length for _, length, _, _ in got) == sum(len(ids) * times for ids, times in expected)
    assert sum(r.length for r in pieces) == sum(len(ids) * n for (_, ids), n in want.items())
    return padding


def Counter_of(items):
    out = defaultdict(int)
    for x in items:
        out[x] += 1
    return out


def test_pieces(edge, small, nothing, encode):
    assert check(edge, encode) == 0
    assert check(small, encode) == 0
    assert p.pack(nothing, PATH).collect() == []


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 9, 64)
    counts[0] = 0
    plan = p.Plan(counts, 64)
    fill = defaultdict(list)
    for length, n in enumerate(counts.tolist()):
        for rank in range(n):
            placed = plan.place(length, rank)
            assert sum(x for x, _, _ in placed) == length
            for size, sequence, offset in placed:
                fill[sequence].append((offset, size))
    assert set(fill) == set(range(plan.sequences_end))
    for own in fill.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at == 64 or at & (at - 1) == 0


def test_repeat_counts_solve_the_histogram():
    counts = np.zeros(11, int)
    counts[[3, 7, 4, 6]] = 5, 5, 2, 2
    combos = p.combinations(counts, 10)
    x = dict(zip(combos, p.repeat_counts(combos, counts)))
    assert x[3, 7] + sum(v for c, v in x.items() if c.count(3) == 2) == pytest.approx(5, abs=0.6) and min(x.values()) >= 0


def test_ranks_are_dense(spark):
    df = spark.range(500).selectExpr("id AS _row", "CAST(IF(id % 3 = 0, 7, id % 5) AS int) AS _rest")
    got = p.ranked(df, 4).join(df, "_row").collect()
    by = defaultdict(list)
    for r in got:
        by[r["_rest"]].append(r["_rank"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(got) == 500
