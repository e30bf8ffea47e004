"""Token ids as fixed-width bit-packed files with random access.

File format (little-endian), one file per range of document ids:

* 8 bytes magic ``TESSPK01``;
* blocks: ``block_ids`` ids each (the last may be shorter), every id in the least number of bits that
  holds the vocabulary, least significant bit first, each block padded to whole bytes;
* footer: for each block its byte offset (uint64); for each document its id (int64), a null flag
  (uint8) and the number of its ids (uint64);
* JSON with ``bits block_ids blocks documents ids``, then its length (uint32) and the magic again.

A block begins at a whole byte, so any span of ids is read by seeking to its first block and unpacking
whole blocks with numpy.

Nulls, empty and long texts: a null or empty text has the end id alone. Rows with the same doc_id are
all kept, in the order of their text's checksum; a null doc_id sorts first. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, partitions, text_of, uri_fs

MAGIC = b"TESSPK01"
BLOCK_IDS = 8192


def bits_for(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, least significant bit first, padded to whole bytes."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    full = np.zeros((n, 32), np.uint8)
    full[:, :bits] = each
    return np.packbits(full, axis=1, bitorder="little").view("<u4").reshape(n).astype(np.uint32)


class PackedWriter:
    """Streams ids into one file; holds one unfinished block and the footer."""

    def __init__(self, sink, bits: int, block_ids: int = BLOCK_IDS) -> None:
        self.sink, self.bits, self.block_ids = sink, bits, block_ids
        self.rest = np.zeros(0, np.uint32)
        self.at, self.ids = len(MAGIC), 0
        self.blocks: list[int] = []
        self.doc_ids: list[int | None] = []
        self.counts: list[np.ndarray] = []
        sink.write(MAGIC)

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.blocks.append(self.at)
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.counts.append(counts)
        self.ids += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) - len(ids) % self.block_ids
        for i in range(0, whole, self.block_ids):
            self._block(ids[i : i + self.block_ids])
        self.rest = ids[whole:]

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        null = np.array([d is None for d in self.doc_ids], np.uint8)
        self.sink.write(np.array(self.blocks, "<u8").tobytes())
        self.sink.write(np.array([d or 0 for d in self.doc_ids], "<i8").tobytes())
        self.sink.write(null.tobytes())
        self.sink.write(np.concatenate([np.zeros(0, np.int64), *self.counts]).astype("<u8").tobytes())
        head = json.dumps({"bits": self.bits, "block_ids": self.block_ids, "blocks": len(self.blocks), "documents": len(self.doc_ids), "ids": self.ids}).encode()
        self.sink.write(head + struct.pack("<I", len(head)) + MAGIC)
        self.sink.close()


@dataclass
class PackedReader:
    """Random access to a file of packed ids."""

    source: object

    def __post_init__(self) -> None:
        f = self.source
        size = f.size()
        f.seek(size - 12)
        tail = f.read(12)
        if tail[4:] != MAGIC:
            raise ValueError("not a packed token file")
        (n,) = struct.unpack("<I", tail[:4])
        f.seek(size - 12 - n)
        head = json.loads(f.read(n))
        self.bits, self.block_ids, self.ids = head["bits"], head["block_ids"], head["ids"]
        blocks, docs = head["blocks"], head["documents"]
        f.seek(size - 12 - n - blocks * 8 - docs * 17)
        self.end = size - 12 - n - blocks * 8 - docs * 17
        self.blocks = np.frombuffer(f.read(blocks * 8), "<u8").astype(np.int64)
        self.doc_ids = np.frombuffer(f.read(docs * 8), "<i8")
        self.null = np.frombuffer(f.read(docs), np.uint8).astype(bool)
        self.counts = np.frombuffer(f.read(docs * 8), "<u8").astype(np.int64)

    def slice(self, begin: int, end: int) -> np.ndarray:
        """Ids at the positions from ``begin`` up to ``end``."""
        if begin >= end:
            return np.zeros(0, np.uint32)
        first, last = begin // self.block_ids, (end - 1) // self.block_ids
        start = self.blocks[first]
        stop = self.blocks[last + 1] if last + 1 < len(self.blocks) else self.end
        self.source.seek(int(start))
        data = self.source.read(int(stop - start))
        out, at = [], 0
        for b in range(first, last + 1):
            n = min(self.block_ids, self.ids - b * self.block_ids)
            size = (n * self.bits + 7) // 8
            out.append(unpack(data[at : at + size], self.bits, n))
            at += size
        return np.concatenate(out)[begin - first * self.block_ids : end - first * self.block_ids]

    def documents(self, most_ids: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, last document + 1, their ids) in runs of about ``most_ids`` ids."""
        ends = np.cumsum(self.counts)
        i, n = 0, len(self.counts)
        while i < n:
            base = int(ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(ends, base + most_ids, side="right")))
            yield i, j, self.slice(base, int(ends[j - 1]))
            i = j


def write_packed(df: DataFrame, folder: str, vocabulary: str, *, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", files: int | None = None) -> list[tuple[str, int, int]]:
    """Encode all texts of ``df`` and write them in ascending doc_id order to files under ``folder``.

    One exchange by ranges of doc_id carries the texts; each range is encoded and written by one
    task. A task writes a file of its own name, so a repeated or lost attempt leaves at most a file
    that the returned manifest doesn't name. Returns (file, documents, ids) per file in order.
    """
    spark = df.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from tessera.llm.encode import byte_level_encoder

        encoder = byte_level_encoder(vocabulary, end_id)
        fs, path = uri_fs(folder)
        part = TaskContext.get().partitionId()
        name, writer = f"{part:06d}-{uuid.uuid4().hex}.tess", None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if texts and writer is None:
                writer = PackedWriter(fs.open_output_stream(f"{path}/{name}"), bits_for(encoder.vocabulary_size))
            begin = 0
            for flat, counts in encoder.encode(texts):
                writer.add(ids[begin : begin + len(counts)], flat, counts)
                begin += len(counts)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "documents": [len(writer.doc_ids)], "ids": [writer.ids]}, schema=pa.schema([("part", pa.int64()), ("file", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))

    fs, path = uri_fs(folder)
    fs.create_dir(path)
    rows = df.select(df[doc_id].cast("long").alias("doc_id"), text_of(df, text).alias("text"))
    rows = rows.repartitionByRange(files or partitions(spark), "doc_id").sortWithinPartitions("doc_id", F.crc32(F.col("text").cast("binary")))
    made = rows.mapInArrow(encode, "part long, file string, documents long, ids long").collect()
    return [(r["file"], r["documents"], r["ids"]) for r in sorted(made, key=lambda r: r["part"])]


def read_packed(spark: SparkSession, folder: str, manifest: list[tuple[str, int, int]]) -> DataFrame:
    """One row per document, read from the files: doc_id, start, n_tokens, ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    rows, base = [], 0
    for name, _, n in manifest:
        rows.append((name, base))
        base += n

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = uri_fs(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{path}/{name}") as f:
                    reader = PackedReader(f)
                    starts = start + np.cumsum(reader.counts) - reader.counts
                    for i, j, ids in reader.documents():
                        cuts = np.cumsum(reader.counts[i:j]).tolist()
                        data = memoryview(ids.astype("<u4").tobytes())
                        sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip([0, *cuts], cuts, strict=False)]
                        yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids[i:j], pa.int64(), mask=reader.null[i:j]), pa.array(starts[i:j]), pa.array(reader.counts[i:j]), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    if not rows:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame(rows, "file string, start long").repartition(max(1, min(len(rows), 4 * partitions(spark))))
    return files.mapInArrow(digest, schema)


def token_files(df: DataFrame, vocabulary: str, folder: str | None = None) -> DataFrame:
    """Write packed files (in the shared folder unless one is named) and return what they hold per document."""
    spark = df.sparkSession
    folder = folder or Scratch(spark, "token-io").path("files")
    return read_packed(spark, folder, write_packed(df, folder, vocabulary))
