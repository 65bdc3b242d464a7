import zlib

import numpy as np
import public_tokenizers as public
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlab.llm import language_id as li

from .conftest import rows_of, same

PATH = public.path("piece_bpe_32k.model")
SMALL = li.Trie([b" ", b" a", b"ab", b"aba", b"ba", b"bab", "é".encode()])


def slice_of(own):
    raw = [t.encode() for t in own]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def by_hand(unit, p, t):
    """(sum over segmentations, expected counts) by listing them all."""
    index = {x: i for i, x in enumerate(t.pieces)}
    found = []

    def cut(rest, so_far):
        if not rest:
            found.append(so_far)
        for k in range(1, len(rest) + 1):
            if rest[:k] in index:
                cut(rest[k:], [*so_far, index[rest[:k]]])
    cut(unit, [])
    weight = [np.prod(p[s]) for s in found]
    count = np.zeros(len(p))
    for s, w in zip(found, weight):
        np.add.at(count, s, w / sum(weight))
    return sum(weight), count


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abé ", min_size=1, max_size=7), min_size=1, max_size=5), st.integers(0, 99))
def test_all_segmentations(units, seed):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet(np.ones(len(SMALL.pieces)), 2).T
    raw = [u.encode() for u in units]
    first = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    lattice = li.Lattice(np.frombuffer(b"".join(raw), np.uint8), first, SMALL)
    for k in range(2):
        hand = [by_hand(r, p[:, k], SMALL) for r in raw]
        assert np.allclose(lattice.log_sums(p)[:, k], np.log([h[0] for h in hand]))
        times = rng.integers(1, 5, len(raw)).astype(float)
        assert np.allclose(lattice.expected(p[:, k], times), sum(t * h[1] for t, h in zip(times, hand)))


def test_units():
    """Lower-cased, space-led, long words in parts, equal ones once, texts kept apart."""
    own = ["One  two\tONE", "", "x" * 100, "two"]
    u = li.units_of(*slice_of(own))
    raw = u.data.tobytes()
    parts = [raw[u.first[i]:u.first[i + 1]] for i in u.of]
    assert parts == [b" one", b" two", b" one", b" " + b"x" * 47, b"x" * 48, b"x" * 5, b" two"]
    assert u.text.tolist() == [0, 0, 0, 2, 2, 2, 3]
    assert len(u.first) - 1 == 5


def test_scores_are_sums_over_words(monkeypatch):
    """Blocks of units and of languages change nothing; unseen bytes don't underflow."""
    t = li.trie(PATH)
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.full(len(t.pieces), 0.05), 5).T * (1 - li.UNIFORM) + li.UNIFORM / len(t.pieces)
    model = li.Model(PATH, list("abcde"), p)
    own = ["the cat the dog", "漢" * 200, "", "\x01" * 300 + " zz", "Ünïcode words, mixed WITH others " * 20]
    whole = model.log_probabilities(*slice_of(own))
    assert np.isfinite(whole).all() and (whole[2] == 0).all()
    monkeypatch.setattr(li, "BLOCK_BYTES", 50)
    monkeypatch.setattr(li, "LANGUAGES", 2)
    assert np.allclose(model.log_probabilities(*slice_of(own)), whole)
    for d, text in enumerate(own):
        assert np.allclose(model.log_probabilities(*slice_of([text]))[0], whole[d])


def test_learning_raises_likelihood():
    words = [b" ab", b" aba", b" b", b" bab"]
    first = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    lattice, times = li.Lattice(np.frombuffer(b"".join(words), np.uint8), first, SMALL), np.array([5.0, 3, 2, 1])
    reached = []
    for n in range(1, 6):
        count = li.learn(words, times, SMALL, n)
        p = (count / count.sum() * (1 - li.UNIFORM) + li.UNIFORM / len(count))[:, None]
        reached.append(float(times @ lattice.log_sums(p)[:, 0]))
    assert all(b > a - 0.05 for a, b in zip(reached, reached[1:])) and reached[-1] > reached[0]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = {r.doc_id: r for r in li.identify(docs, PATH).collect()}
    assert got.keys() == lang.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    held = [r.lang_pred == lang[i] for i, r in got.items() if r.held_out]
    assert np.mean(held) >= 0.99


def test_edges(edge, nothing, spark):
    got = li.identify(edge, PATH).collect()
    same([r.doc_id for r in got], [r.doc_id for r in edge.select("doc_id").collect()])
    text = {}
    for i, t in rows_of(edge):
        text.setdefault(i, []).append(t)
    for r in got:
        lettered = [t is not None and any(c.isalpha() for c in t) for t in text[r.doc_id]]
        assert r.lang_pred in {"en" if x else "und" for x in lettered}
        assert r.score == (1.0 if r.lang_pred == "en" else 0.0)      # one language
    assert li.identify(nothing, PATH).collect() == []
    rows = [(1, "abc", None), (2, None, "en"), (3, "12 ٣", "de"), (5, "wort", ""), (6, "漢字", "zz"), (8, "", "fr")]
    one = {r.doc_id: r for r in li.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PATH).collect()}
    assert one[2].lang_pred == "und" and one[3].lang_pred == "und" and one[8].lang_pred == "und"
    none = li.identify(spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string"), PATH)
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}


def test_more_texts_than_learned(spark, monkeypatch):
    """About as many texts as the bound are learned from, repeated rows once; all rows are predicted."""
    monkeypatch.setattr(li, "TRAIN_DOCS", 100)
    rows = [(i, f"haus baum{i % 7} und der die das", "de") for i in range(900)] * 2 + [(1000 + i, f"the house tree{i} and", "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    words = {r[0]: r[1] for r in li.training_words(docs).groupBy("lang").sum("n").collect()}
    kept = [i for i in range(1000, 1060) if zlib.crc32(str(i).encode()) % 5]
    assert words["en"] == 4 * len(kept)                       # fewer rows than the bound: all of them
    assert words["de"] % 6 == 0 and 25 <= words["de"] // 6 <= 80      # 1,440 rows, 720 different: 50 expected
    got = li.identify(docs, PATH).collect()
    assert len(got) == 1860 and all(r.lang_pred == ("de" if r.doc_id < 1000 else "en") for r in got)


@pytest.mark.parametrize("byte", [0, 32, 255])
def test_every_byte_is_a_piece(byte):
    assert bytes([byte]) in set(li.trie(PATH).pieces)


def test_text_over_a_megabyte():
    """A long text's score is that of its words, as often as they occur; one endless word is finite too."""
    t = li.trie(PATH)
    p = np.random.default_rng(2).dirichlet(np.full(len(t.pieces), 0.05), 3).T * (1 - li.UNIFORM) + li.UNIFORM / len(t.pieces)
    model = li.Model(PATH, list("abc"), p)
    few, many = model.log_probabilities(*slice_of(["eine zwei drei"])), model.log_probabilities(*slice_of(["eine zwei drei " * 100_000]))
    assert np.allclose(many, few * 100_000)
    assert np.isfinite(model.log_probabilities(*slice_of(["é漢x" * 250_000]))).all()
