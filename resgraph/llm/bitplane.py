"""Token-id files of bit-plane shuffled chunks.

A shard file holds, after its magic number, chunks of CHUNK ids (the last may be shorter). A chunk's 32-bit ids are
transposed into byte planes (plane k: byte k of every id) or bit planes (plane k: bit k of every id, packed), and each
plane is a zstandard frame of its own; a plane of zeros takes a few bytes. The footer indexes the chunks (offset, ids)
and the documents (id, ids in each), so that any document or chunk is read without the others.

    b"BPLANES1" | chunk... | footer (zstandard) | length of footer, u32 | b"BPLANES1"
    chunk:  ids u32 | planes u8 | length of each plane u32... | planes
    footer: plane kind u8 | chunks u32 | documents u32 | chunk offsets u64... | chunk ids u32... | document ids i64... | document lengths u32...

Shards are cut by range of document id and sorted, so shard order and order within a shard give the global order; rows
that repeat a document id stay together, null ids come first (as the least i64). A null or empty text has only the end
id. Files carry a name of their own for each attempt, and the manifest lists those of finished tasks alone.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resgraph.llm.byte_bpe import byte_bpe
from resgraph.llm.common import new_path, staged

MAGIC = b"BPLANES1"
CHUNK = 1 << 16
NULL_ID = -(1 << 63)
MANIFEST = "shard int, path string, n_ids long, n_docs long"


def shuffle(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The planes of a block of ids."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, k].tobytes() for k in range(4)]
    planes = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    return [plane.tobytes() for plane in planes]


def unshuffle(planes: list[bytes], n: int) -> np.ndarray:
    """The block of n ids that has these planes."""
    if len(planes) == 4:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.unpackbits(np.stack([np.frombuffer(p, np.uint8) for p in planes]), axis=1, count=n, bitorder="little")
        raw = np.packbits(bits.T, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


class Writer:
    def __init__(self, sink, bits: bool = False, chunk: int = CHUNK):
        self._sink, self._bits, self._chunk = sink, bits, chunk
        self._pack = zstandard.ZstdCompressor(level=3)
        self._open, self._held = [], 0
        self._offsets, self._sizes, self._docs, self._lengths = [], [], [], []
        self._sink.write(MAGIC)
        self._at = len(MAGIC)
        self.n_ids = 0

    def add(self, doc: int, ids: np.ndarray) -> None:
        self._docs.append(doc)
        self._lengths.append(len(ids))
        self._open.append(ids)
        self._held += len(ids)
        if self._held >= self._chunk:
            flat = np.concatenate(self._open)
            whole = len(flat) // self._chunk * self._chunk
            for i in range(0, whole, self._chunk):
                self._write(flat[i : i + self._chunk])
            self._open, self._held = [flat[whole:]], len(flat) - whole

    def _write(self, ids: np.ndarray) -> None:
        planes = [self._pack.compress(p) for p in shuffle(ids, self._bits)]
        raw = struct.pack(f"<IB{len(planes)}I", len(ids), len(planes), *map(len, planes)) + b"".join(planes)
        self._offsets.append(self._at)
        self._sizes.append(len(ids))
        self._sink.write(raw)
        self._at += len(raw)
        self.n_ids += len(ids)

    def close(self) -> None:
        if self._held:
            self._write(np.concatenate(self._open))
        parts = [np.array(self._offsets, "<u8"), np.array(self._sizes, "<u4"), np.array(self._docs, "<i8"), np.array(self._lengths, "<u4")]
        footer = self._pack.compress(struct.pack("<BII", self._bits, len(self._sizes), len(self._docs)) + b"".join(p.tobytes() for p in parts))
        self._sink.write(footer + struct.pack("<I", len(footer)) + MAGIC)


class Reader:
    def __init__(self, source):
        self._source = source
        size = source.size()
        source.seek(size - 12)
        tail = source.read(12)
        if tail[4:] != MAGIC:
            raise ValueError("not a bit-plane file")
        (n,) = struct.unpack("<I", tail[:4])
        source.seek(size - 12 - n)
        raw = zstandard.decompress(source.read(n))
        _, chunks, docs = struct.unpack_from("<BII", raw)
        at = 9
        self.offsets = np.frombuffer(raw, "<u8", chunks, at)
        self.sizes = np.frombuffer(raw, "<u4", chunks, at := at + 8 * chunks)
        self.docs = np.frombuffer(raw, "<i8", docs, at := at + 4 * chunks)
        self.lengths = np.frombuffer(raw, "<u4", docs, at + 8 * docs)

    def chunk(self, k: int) -> np.ndarray:
        self._source.seek(int(self.offsets[k]))
        n, planes = struct.unpack("<IB", self._source.read(5))
        lengths = struct.unpack(f"<{planes}I", self._source.read(4 * planes))
        return unshuffle([zstandard.decompress(self._source.read(x)) for x in lengths], n)

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """(document id, its ids), one chunk in memory at a time beside the document's own."""
        held, k, at = np.zeros(0, np.uint32), 0, 0
        for doc, n in zip(self.docs.tolist(), self.lengths.tolist(), strict=True):
            parts = []
            while n:
                if at == len(held):
                    held, k, at = self.chunk(k), k + 1, 0
                parts.append(held[at : at + n])
                at += len(parts[-1])
                n -= len(parts[-1])
            yield doc, np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write(docs: DataFrame, folder: str, vocabulary: str, id: str = "doc_id", text: str = "text", end: int = 0, bits: bool = False) -> DataFrame:
    """Encode texts and write shard files in order of id; returns the manifest (shard, path, n_ids, n_docs)."""
    spark = docs.sparkSession
    local, where = _at(folder)
    local.create_dir(where, recursive=True)
    stop = np.array([end], "<u4").tobytes()

    def run(batches):
        task = TaskContext.get()
        name = f"{where}/shard-{task.partitionId():06d}-{uuid.uuid4().hex}.bpl"
        files, sink, writer, n = _at(folder)[0], None, None, 0
        coder = byte_bpe(vocabulary)
        for batch in batches:
            for doc, said in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    sink = files.open_output_stream(name)
                    writer = Writer(sink, bits)
                writer.add(NULL_ID if doc is None else doc, np.frombuffer(coder.encode(said.as_py() or "") + stop, "<u4"))
                n += 1
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([name]), pa.array([writer.n_ids], pa.int64()), pa.array([n], pa.int64())], ["shard", "path", "n_ids", "n_docs"])

    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    manifest = rows.repartitionByRange(n, "id").sortWithinPartitions("id").mapInArrow(run, MANIFEST)
    return staged(manifest, "manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document from the files of a manifest."""

    def run(batches):
        files = _at(folder)[0]
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                with files.open_input_file(path) as source:
                    for doc, ids in Reader(source).documents():
                        rows.append((None if doc == NULL_ID else doc, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    starts = manifest.withColumn("start", F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return starts.select("path", "start").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(docs: DataFrame, vocabulary: str, **how) -> DataFrame:
    """Write docs to files in the shared folder and read them back."""
    folder = new_path(docs.sparkSession, "ids")
    return read(write(docs, folder, vocabulary, **how), folder)
