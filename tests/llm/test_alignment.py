import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortlab.llm import alignment as al

from .conftest import rows_of, same

A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    """text -> ((id, bytes) of A, of B), straight from the libraries."""
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in letters}
    letter |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters)}
    s = sentencepiece.SentencePieceProcessor(model_file=B)

    def both(text):
        a = [(i, bytes(letter[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode())
             for i in s.encode(text)]
        whole = (" " + text).encode()
        ok = text and b"".join(p for _, p in a) == whole == b"".join(p for _, p in b)
        return (a, b) if ok else ([], [])
    return both


def plain(rows, sides):
    """Brute force: groups and links of every text, counts over all."""
    found, count = [], Counter()
    for doc, text in rows:
        a, b = sides(text or "")
        ends = []
        for side in (a, b):
            at, own = 0, {}
            for i, p in side:
                at += len(p)
                own[at] = i
            ends.append(own)
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups, before = [], 0
        for e in shared:
            groups.append("|".join(",".join(str(own[x]) for x in sorted(own) if before < x <= e) for own in ends))
            before = e
        links = [(ends[0][e], ends[1][e]) for e in shared]
        count.update(links)
        found.append((doc, len(a), len(b), links, ";".join(groups)))
    top = Counter()
    for (_, j), n in count.items():
        top[j] = max(top[j], n)
    return [(doc, n, m, len(links), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links),
             hashlib.sha256(g.encode()).hexdigest() if n else "") for doc, n, m, links, g in found]


def tuples(df):
    return [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()]


def test_small_table(small, sides):
    same(tuples(al.align(small, A, B)), plain(rows_of(small), sides))


ODD = ["x  y   z ", " lead", "▁mark", "a▁b", "tab\tnew\nline ", "　wide", "café ﬁ é", "漢字 かな 🙂", "<s> <unk> </s>",
       "<|endoftext|>", " ", "  ", "\x00\x01", "a" * 300, "…—“q”", "don't I'VE", "0123456789 12 ٣٤", "\xa0nb sp"]


def test_edges(edge, nothing, spark, sides):
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    for df in (edge, odd, nothing):
        same(tuples(al.align(df, A, B)), plain(rows_of(df), sides))


def test_overlaps_and_spans(edge, sides):
    """The operator's own output: ends, group ends, and overlaps that cover every byte once."""
    want = {}
    for doc, text in rows_of(edge):
        a, b = sides(text or "")
        want.setdefault(doc, []).append((np.cumsum([len(p) for _, p in a]).tolist(), np.cumsum([len(p) for _, p in b]).tolist()))
    for r in al.alignments(edge, A, B).collect():
        assert (r.a_ends, r.b_ends) in want[r.doc_id]
        assert r.group_ends == sorted(set(r.a_ends) & set(r.b_ends))
        before = 0
        assert r.overlap_ends == sorted(set(r.a_ends) | set(r.b_ends))
        for i, j, e in zip(r.overlap_a, r.overlap_b, r.overlap_ends):
            for k, ends in ((i, r.a_ends), (j, r.b_ends)):
                assert (ends[k - 1] if k else 0) <= before < e <= ends[k]
            before = e


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(1, 60), min_size=1), st.sets(st.integers(1, 60), min_size=1), st.integers(1, 9))
def test_merge_path(a, b, steps):
    last = max(a | b)
    a, b = np.array(sorted(a | {last})), np.array(sorted(b | {last}))
    i, j = al.diagonals(a, b, steps)
    merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
    for p, q in zip(i, j):
        assert merged[:p + q] == sorted([(x, 0) for x in a[:p]] + [(x, 1) for x in b[:q]])
    got = al.merge(a, b, steps)
    ends = sorted(set(a) | set(b))
    assert got.end.tolist() == ends
    assert got.a.tolist() == [int(np.searchsorted(a, e)) for e in ends]
    assert got.b.tolist() == [int(np.searchsorted(b, e)) for e in ends]
    assert got.closes.tolist() == [e in a and e in b for e in ends]


def test_without_chunks(monkeypatch, small, sides):
    """A model whose pieces cross spaces is asked for whole texts."""
    t = al.tables(A, B)
    monkeypatch.setattr(t.second, "by_chunk", False)
    for text in [r.text for r in small.limit(20).collect() if r.text] + ODD:
        raw = np.frombuffer(text.encode(), np.uint8)
        x = al.align_slice(raw, np.array([0, len(raw)]), A, B)
        a, b = sides(text)
        assert x.a.tolist() == [i for i, _ in a] and x.b.tolist() == [i for i, _ in b]


def test_pairs_are_bounded_by_the_vocabularies():
    t = al.tables(A, B)
    assert len(t.keys) < 1_000_000 and (np.diff(t.keys) > 0).all()


@pytest.mark.parametrize("text", ["two words " * 150_000, "ab" * 600_000, " " * 1_100_000])
def test_text_over_a_megabyte(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    x = al.align_slice(raw, np.array([0, len(raw)]), A, B)
    assert x.a_end[-1] == x.b_end[-1] == len(raw) + 1
    ends = np.intersect1d(x.a_end, x.b_end)
    assert x.overlaps.end[x.overlaps.closes].tolist() == ends.tolist()
    assert len(al.group_texts(x, 1 << 16)) == 1
