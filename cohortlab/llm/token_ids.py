"""Token ids by a byte-level BPE file of the tokenizers library.

Equal pieces get equal ids, so only pieces new to a worker's table are merged. A vocabulary
whose merges stand in the order of their ids is merged by rank (tiktoken's merge of one
piece, on the ranks of the same file); any other goes through the tokenizers library piece
by piece. Texts with letters beyond the Latin blocks, whose classes depend on the Unicode
version a library was built with, go through the tokenizers library whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame

from .arrays import docs_of, per_doc, release
from .bpe import piece_starts
from .piece_table import PieceTable

PLAIN_LEAD = 0xC9           # UTF-8 lead bytes below it: code points under U+0240
_ready: dict[str, tuple] = {}


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level BPE file; added tokens stand for their own text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letter, out = byte_letters(), {}
    for piece, i in spec["model"]["vocab"].items():
        out[i] = bytes(letter[c] for c in piece) if all(c in letter for c in piece) else piece.encode()
    for added in spec["added_tokens"]:
        out[added["id"]] = added["content"].encode()
    return [out.get(i, b"") for i in range(max(out) + 1)]


def rank_merger(path: str):
    """Function from pieces to ids when ids rank the merges, else None."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, vocab = spec["model"], spec["model"]["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    by_rank = all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(pairs))
    plain = not (spec["normalizer"] or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges")
                 or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
    if not (by_rank and plain):
        return None
    ranks = {b: i for i, b in enumerate(vocabulary(path)) if i < 256 + len(pairs)}
    if len(ranks) != 256 + len(pairs):
        return None
    merge = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    return lambda pieces: [merge(p) for p in pieces]


def library(path: str):
    """(tokenizer, table of pieces) of this Python worker."""
    if path not in _ready:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True      # their strings in a text are ordinary text

        def by_library(pieces: list[bytes]) -> list[list[int]]:
            return [x.ids for x in tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        kind = "<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        _ready[path] = tokenizer, PieceTable(rank_merger(path) or by_library, kind)
    return _ready[path]


def slice_ids(data: np.ndarray, off: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the texts of a slice one behind the other, number of ids of each text)."""
    tokenizer, table = library(path)
    start = piece_starts(data, off)
    ids, count = table.ids(data, start, np.append(start[1:], len(data)))
    bound = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(start, off)]
    foreign = np.flatnonzero(per_doc(data >= PLAIN_LEAD, off))
    if len(foreign):
        own = np.split(ids, bound[1:-1])
        text = data.tobytes()
        for d in foreign.tolist():
            own[d] = np.array(tokenizer.encode(text[off[d]:off[d + 1]].decode(), add_special_tokens=False).ids, ids.dtype)
        return np.concatenate(own), np.array([len(x) for x in own], np.int64)
    return ids, np.diff(bound)


def encode_slice(data: np.ndarray, off: np.ndarray, path: str, end_id: int, kind: str) -> list[bytes]:
    """Packed ids of each text of a slice, the end id last; ``kind`` is "<u2" or "<u4"."""
    ids, count = slice_ids(data, off, path)
    stop = np.cumsum(count)
    closed = np.insert(ids, stop, np.array(end_id, ids.dtype)).astype(kind, copy=False)
    packed, size = closed.tobytes(), np.dtype(kind).itemsize
    cut = (size * (stop + np.arange(1, len(stop) + 1))).tolist()
    return [packed[a:b] for a, b in zip([0, *cut], cut)]


def id_kind(path: str) -> str:
    """Two bytes an id when the vocabulary allows it."""
    return "<u2" if library(path)[0].get_vocab_size() <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, path: str, end_id: int, kind: str) -> DataFrame:
    """(doc_id, ids, n_tokens) of each row of ``docs(doc_id, text)``; a null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.dtype(kind).itemsize
        for batch in batches:
            keys = batch.column("doc_id").cast(pa.int64())
            for i, j, data, off in docs_of(batch):
                ids = encode_slice(data, off, path, end_id, kind)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(i, j - i), pa.array(ids, pa.binary()),
                     pa.array([len(x) // size for x in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, n_tokens long")
