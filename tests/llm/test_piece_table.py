import random

import numpy as np
import public_tokenizers as public
import pytest
from tokenizers import Tokenizer

from cohortlab.llm import piece_table as pt
from cohortlab.llm import token_ids as ti

PATH = public.path("byte_bpe_50k.json")


def texts(n, seed):
    rnd = random.Random(seed)
    alphabet = "abcdeéß  \n\t'0123#漢٣\x00ſ"
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.choice([0, 1, 7, 60, 900]))) for _ in range(n)] + ["x" * 5000, " " * 400, "don't we'LL"]


def as_slice(own):
    raw = [t.encode() for t in own]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


@pytest.mark.parametrize("by_rank", [True, False])
def test_ids_equal_the_library(monkeypatch, by_rank):
    if not by_rank:
        monkeypatch.setattr(ti, "rank_merger", lambda path: None)
    monkeypatch.setattr(ti, "_ready", {})
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    for seed in range(4):
        own = texts(60, seed)
        for kind in ("<u2", "<u4"):
            got = ti.encode_slice(*as_slice(own), PATH, 2, kind)
            assert [np.frombuffer(g, kind).tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids + [2] for x in own]


def test_every_entry_is_merged_alike():
    """All entries of the vocabulary as pieces: by rank and by the library."""
    merge = ti.rank_merger(PATH)
    t = Tokenizer.from_file(PATH)
    pieces = []
    for b in ti.vocabulary(PATH)[:50256]:
        try:
            pieces.append(b.decode())
        except UnicodeDecodeError:
            pass
    raw = [p.encode() for p in pieces]
    own = t.model
    want = [[x.id for x in own.tokenize("".join(next(c for c, v in LETTERS.items() if v == b) for b in r))] for r in raw[::50]]
    assert merge(raw[::50]) == want


LETTERS = ti.byte_letters()


def test_small_table_starts_anew(monkeypatch):
    """More distinct pieces over time than the table holds; keys that differ only in zero bytes or length."""
    monkeypatch.setattr(pt, "SLOTS", 256)
    monkeypatch.setattr(pt, "FULL", 128)
    monkeypatch.setattr(pt, "LONG_PIECES", 5)
    asked = []

    def encode(pieces):
        asked.extend(pieces)
        return [[len(p), sum(p) % 60000] for p in pieces]
    table = pt.PieceTable(encode)
    rnd = random.Random(2)
    for _ in range(60):
        own = [bytes(rnd.choice(b"\x00ab") for _ in range(rnd.choice([1, 2, 3, 8, 9, 16, 17, 40]))) for _ in range(70)]
        end = np.cumsum([len(p) for p in own])
        start = end - [len(p) for p in own]
        ids, count = table.ids(np.frombuffer(b"".join(own), np.uint8), start, end)
        assert ids.tolist() == [x for p in own for x in (len(p), sum(p) % 60000)] and set(count.tolist()) == {2}
    own = [b"%d" % i for i in range(1000)]            # more distinct pieces in one call than the table holds
    end = np.cumsum([len(p) for p in own])
    ids, _ = table.ids(np.frombuffer(b"".join(own), np.uint8), end - [len(p) for p in own], end)
    assert ids.tolist() == [x for p in own for x in (len(p), sum(p) % 60000)]
