import hashlib
import random

import numpy as np

from cohortlab.llm import suffix_dedup as s

from . import brute
from .conftest import rows_of, same


def check(df):
    rows = rows_of(df)
    want = brute.repeats(rows)
    same([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.dedup(df).collect()],
         [(i, n, m, k, hashlib.sha256(kept).hexdigest()) for i, t in rows for n, m, k, kept in [want[i, t]]])


def test_edge_rows(edge):
    check(edge)


def test_small_table(small):
    check(small)


def test_empty(nothing):
    assert s.dedup(nothing).collect() == []


def test_overlapping_pieces(spark, monkeypatch):
    """Pieces of few passages, glued at random: families with many contexts, in several runs."""
    rnd = random.Random(5)

    def word():
        return "".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 6)))

    passages = [" ".join(word() for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(80):
        t = ""
        for _ in range(rnd.randint(1, 5)):
            x = rnd.choice(passages)
            a = rnd.randrange(len(x))
            t += x[a:min(len(x), a + rnd.randint(20, 250))] + rnd.choice(["", "é", word()])
        rows.append((i, t))
    monkeypatch.setattr(s, "RUN_BYTES", 2000)
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_loser_tree_merges_like_sorting():
    rnd = random.Random(8)
    runs, all_ = [], []
    for _ in range(11):
        own = sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 12))) + b"\0" for _ in range(rnd.randint(0, 30)))
        own = sorted(set(own))
        lcp = [0] + [s.common(a, b, 0) for a, b in zip(own, own[1:])]
        runs.append((own, lcp[:len(own)]))
        all_ += own
    out = [(runs[r][0][i], c) for r, i, c in s.merge(runs)]
    assert [x for x, _ in out] == sorted(all_)
    assert [c for _, c in out[1:]] == [s.common(a, b, 0) for (a, _), (b, _) in zip(out, out[1:])]


def test_every_window_has_its_anchor():
    data = np.frombuffer(b"abcabcabd" * 60 + b"x" * 300, np.uint8)
    p, lo, hi, _ = s.units(data, np.array([0, 540, 840]))
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi)])
    assert covered.tolist() == [*range(0, 441), *range(540, 741)]
    assert ((p >= hi) & (p + s.GRAM <= lo + s.LENGTH)).all()


def test_text_stays_valid_and_columns_stay(edge):
    out = s.without_repeats(edge)
    assert out.columns == edge.columns
    want = brute.repeats(rows_of(edge))
    got = out.collect()
    same([(r.doc_id, r.text) for r in got], [(i, t if not n[1] else n[3].decode("utf-8", "ignore")) for (i, t) in rows_of(edge) for n in [want[i, t]]])
    assert all(r.n_chars == len(r.text or "") for r in got)
