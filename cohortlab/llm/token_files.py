"""Token files: one zstandard frame per document under a shared dictionary.

A shard holds frames in ascending doc_id order, an index (doc_id, place, ids before
it in the shard, number of ids) and a footer with the dictionary's hash, so that a
short document is read with two small reads and one decompression. The dictionary
is trained on the serialized ids of a bounded sample of short documents.

Shards are written by the tasks of one job, each under a name of its own; the list of
shards is a table written by the same job, so files left by a lost attempt are never
read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import docs_of, release
from .tables import fresh_path, stored
from .token_ids import encode_slice, encoded, id_kind

END_ID = 2
MAGIC = b"IDSZ0001"
FOOTER = struct.Struct("<32sQQB7x8s")       # dictionary hash, place of the index, documents, bytes an id, magic
INDEX = np.dtype([("doc_id", "<i8"), ("null_id", "u1"), ("place", "<u8"), ("size", "<u4"), ("before", "<u8"), ("n", "<u8")])
SHARD_BYTES = 8 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_DOCS, SAMPLE_DOC_BYTES = 400, 32 << 10     # at most so many documents, each at most so long, train the dictionary


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def train_dictionary(docs: DataFrame, path: str, kind: str) -> bytes:
    """Dictionary from the documents with the smallest id hashes; empty where the sample is too small."""
    few = (docs.select("doc_id", "text").filter(F.octet_length("text").between(1, SAMPLE_DOC_BYTES))
           .orderBy(F.xxhash64("doc_id"), "text").limit(SAMPLE_DOCS))
    samples = [bytes(r.ids) for r in encoded(few, path, END_ID, kind).select("ids").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def packer(dictionary: bytes):
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return (zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=False),
            zstandard.ZstdDecompressor(dict_data=known))


class Shard:
    """Frames gathered for one file."""

    def __init__(self, kind: str, digest: bytes):
        self.kind, self.digest = kind, digest
        self.frames, self.index, self.place, self.ids = [], [], 0, 0

    def add(self, doc_id: int | None, frame: bytes, n: int) -> None:
        self.index.append((doc_id or 0, doc_id is None, self.place, len(frame), self.ids, n))
        self.frames.append(frame)
        self.place += len(frame)
        self.ids += n

    def write(self, folder: str, name: str) -> str:
        store, base = open_store(folder)
        with store.open_output_stream(f"{base}/{name}") as out:
            for frame in self.frames:
                out.write(frame)
            out.write(np.array(self.index, INDEX).tobytes())
            out.write(FOOTER.pack(self.digest, self.place, len(self.index), np.dtype(self.kind).itemsize, MAGIC))
        return f"{folder}/{name}"


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs(doc_id, text)`` as shards under ``folder``; returns the stored list of shards.

    Rows are dealt by ranges of (doc_id, hash of the text), so one id's rows may span tasks;
    null ids come first. The list has (part, number, path, n_docs, n_tokens).
    """
    spark = docs.sparkSession
    kind = id_kind(path)
    dictionary = train_dictionary(docs, path, kind)
    digest = hashlib.sha256(dictionary).digest()
    store, base = open_store(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/dictionary") as out:
        out.write(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, _ = packer(dictionary)
        part, size, number = TaskContext.get().partitionId(), np.dtype(kind).itemsize, 0
        shard = Shard(kind, digest)

        def closed():
            where = shard.write(folder, f"shard-{part:06d}-{number:05d}-{uuid.uuid4().hex}.ids")
            return pa.RecordBatch.from_pylist([{
                "part": part, "number": number, "path": where, "n_docs": len(shard.index), "n_tokens": shard.ids}])

        for batch in batches:
            keys = batch.column("doc_id").cast(pa.int64())
            for i, j, data, off in docs_of(batch):
                for key, ids in zip(keys.slice(i, j - i).to_pylist(), encode_slice(data, off, path, end_id, kind)):
                    shard.add(key, pack.compress(ids), len(ids) // size)
                    if shard.place >= SHARD_BYTES:
                        yield closed()
                        number, shard = number + 1, Shard(kind, digest)
        if shard.index:
            yield closed()
        release()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    dealt = keyed.repartitionByRange(n, "doc_id", "_hash").sortWithinPartitions("doc_id", "_hash")
    listing = dealt.select("doc_id", "text").mapInArrow(
        write, "part long, number long, path string, n_docs long, n_tokens long")
    return stored(listing, "token-shards")


def read_index(store: pafs.FileSystem, place: str) -> tuple[np.ndarray, tuple]:
    with store.open_input_file(place) as f:
        end = f.size()
        f.seek(end - FOOTER.size)
        footer = FOOTER.unpack(f.read(FOOTER.size))
        if footer[-1] != MAGIC:
            raise ValueError(f"not a shard: {place}")
        f.seek(footer[1])
        return np.frombuffer(f.read(footer[2] * INDEX.itemsize), INDEX), footer


def read_dictionary(folder: str, digest: bytes) -> bytes:
    store, base = open_store(folder)
    with store.open_input_file(f"{base}/dictionary") as f:
        dictionary = f.read()
    if hashlib.sha256(dictionary).digest() != digest:
        raise ValueError("the shard was written with another dictionary")
    return dictionary


def read_document(path: str, doc_id: int) -> np.ndarray | None:
    """Ids of one document by its shard: index, one frame, one decompression."""
    store, place = open_store(path)
    index, footer = read_index(store, place)
    at = np.flatnonzero((index["doc_id"] == doc_id) & (index["null_id"] == 0))
    if not len(at):
        return None
    entry = index[at[0]]
    _, unpack = packer(read_dictionary(path.rpartition("/")[0], footer[0]))
    with store.open_input_file(place) as f:
        f.seek(int(entry["place"]))
        return np.frombuffer(unpack.decompress(f.read(int(entry["size"]))), f"<u{footer[3]}")


def read_shards(listing: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of the listed shards."""
    # a row per shard: the only window without a key
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = listing.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    n = int(listing.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                store, place = open_store(path)
                index, footer = read_index(store, place)
                if footer[0] not in known:
                    known[footer[0]] = packer(read_dictionary(path.rpartition("/")[0], footer[0]))
                unpack = known[footer[0]][1]
                with store.open_input_file(place) as f:
                    frames = f.read(footer[1])
                for i in range(0, len(index), 1000):
                    rows = index[i:i + 1000]
                    ids = [unpack.decompress(frames[p:p + s]) for p, s in zip(rows["place"].tolist(), rows["size"].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows["doc_id"], mask=rows["null_id"] == 1),
                         pa.array(rows["before"].astype(np.int64) + start),
                         pa.array([len(x) // footer[3] for x in ids], pa.int64()),
                         pa.array([zlib.crc32(np.frombuffer(x, f"<u{footer[3]}").astype("<u4")) for x in ids], pa.int64()),
                         pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return placed.repartition(n, "path").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Write ``docs(doc_id, text)`` and read the files back: one row per row, without the ids.

    A null or empty text is its end id alone; null ids come first and stay null; rows that
    repeat an id follow each other by the hash of their texts; other columns are ignored; an
    empty table gives no shard and no rows.
    """
    listing = write_shards(docs, path, fresh_path(docs.sparkSession, "token-files"))
    return read_shards(listing).drop("ids")
