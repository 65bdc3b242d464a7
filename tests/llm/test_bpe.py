import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers as public
import pytest
import tiktoken

from cohortlab.llm import bpe
from cohortlab.llm.arrays import byte_view

from .conftest import rows_of, same

PATH = public.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_round_trip(edge, small, nothing, library):
    for df in (edge, small):
        want = []
        for i, t in rows_of(df):
            ids = np.array(library.encode_ordinary(t or ""), "<u4")
            want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), True))
        same([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.equal) for r in bpe.round_trip(df, PATH).collect()], want)
    assert bpe.round_trip(nothing, PATH).collect() == []


def test_boundaries_against_the_library(library):
    rnd = random.Random(4)
    parts = ["'s", "'re", "'ll", "'", "''", " ", "  ", "\n", "\t", "a", "S", "ß", "é", "1", "٣", "!", "#", "　", "'ve", "'d", "x",
             "'m", "'t", "'r", "l", "\x1c", "​", "漢", "😀", "²"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts += ["a" * 3000, "ab" * 4000, " " * 500, "'" * 99, "the" * 700]
    got = bpe.encode_slice(*byte_view(pa.array(texts)), bpe.codec(PATH)[0])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode_ordinary(t) for t in texts]


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 10)
    cache = bpe.Cache(bpe.read_ranks(PATH))
    for i in range(100):
        cache[f"w{i}".encode()]
    assert len(cache) <= 10


def test_decoder_offsets(library):
    ids = np.array(library.encode_ordinary("some words, 12 numbers"), np.int64)
    back, offset = bpe.codec(PATH)[1].decode(ids)
    assert back.tobytes() == b"some words, 12 numbers"
    assert [back[a:b].tobytes() for a, b in zip(offset[:-1], offset[1:])] == [library.decode_single_token_bytes(i) for i in ids.tolist()]
