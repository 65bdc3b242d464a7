import hashlib
import zlib

import numpy as np
import public_tokenizers as public
import pytest
from tokenizers import Tokenizer

from cohortlab.llm import token_files as f
from cohortlab.llm.tables import fresh_path

from .conftest import rows_of, same

PATH = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encode():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def test_files_hold_every_document(edge, small, nothing, encode):
    for df in (edge, small):
        got = f.round_trip(df, PATH).collect()
        same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got],
             [(i, len(x), zlib.crc32(x)) for i, t in rows_of(df) for x in [encode(t)]])
        at = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
        ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
        known = [i for i in ids if i is not None]
        assert known == sorted(known) and ids[:len(ids) - len(known)] == [None] * (len(ids) - len(known))
    assert f.round_trip(nothing, PATH).collect() == []


def test_one_document_by_the_index(spark, small, encode, monkeypatch):
    monkeypatch.setattr(f, "SHARD_BYTES", 20_000)
    listing = f.write_shards(small, PATH, fresh_path(spark, "token-files-test")).collect()
    assert len(listing) > 8
    texts = dict(rows_of(small))
    for row in listing[:3]:
        store, place = f.open_store(row.path)
        index, footer = f.read_index(store, place)
        assert len(index) == row.n_docs
        assert footer[0] == hashlib.sha256(f.read_dictionary(row.path.rpartition("/")[0], footer[0])).digest()
        doc_id = int(index["doc_id"][-1])
        assert f.read_document(row.path, doc_id).tolist() == encode(texts[doc_id]).tolist()
        assert f.read_document(row.path, 10**9) is None


def test_wrong_dictionary_is_refused(spark, small):
    row = f.write_shards(small.limit(5), PATH, fresh_path(spark, "token-files-test")).first()
    with pytest.raises(ValueError):
        f.read_dictionary(row.path.rpartition("/")[0], b"\0" * 32)
