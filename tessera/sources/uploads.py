"""Uploads in parts to files: parts come in any order and more than once, a file appears only when it is whole.

Parts are rows (upload, name, offset, data, total); ``sha256`` of the whole file may come with any of them. Spark deals them by upload and sorts them by offset; a task
writes each file as a stream while its parts pass, so no file and no list of parts is held in memory, and gives it its name at the end. A task that runs again writes under
another temporary name, and moves the same bytes to the same place.

A repeated part is dropped. ``gap``, ``overlap`` (a part that begins among bytes already written and is no repeat of the last), ``short`` (less than ``total``), ``checksum`` and ``unnamed``
are named with their place; such an upload leaves no file. Nulls: a part without upload or offset is left out, null data are no bytes. Parts without bytes make an empty file.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FILES = "upload string, name string, path string, size long, sha256 string, defect string, place long"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class _File:
    """One upload as it is written."""

    def __init__(self, store: fs.FileSystem, folder: str, upload: str) -> None:
        self.store, self.folder, self.upload = store, folder, upload
        self.own = f"{folder}/.{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        self.out = store.open_output_stream(self.own)
        self.size, self.sha = 0, hashlib.sha256()
        self.name = self.total = self.wanted = self.defect = self.place = self.last = None

    def part(self, offset: int, data: bytes, name: str | None, total: int | None, wanted: str | None) -> None:
        self.name, self.total, self.wanted = self.name or name, total if self.total is None else self.total, self.wanted or wanted
        if self.defect or not data:
            return
        if offset == self.size:
            self.out.write(data)
            self.sha.update(data)
            self.size, self.last = self.size + len(data), (offset, hashlib.sha256(data).digest())
        elif offset > self.size:
            self.defect, self.place = "gap", self.size
        elif (offset, hashlib.sha256(data).digest()) != self.last:
            self.defect, self.place = "overlap", offset

    def close(self) -> dict:
        self.out.close()
        if not self.defect:
            checks = {"short": self.total is not None and self.size != self.total, "checksum": self.wanted is not None and self.wanted.lower() != self.sha.hexdigest(), "unnamed": not self.name}
            self.defect = next((k for k, bad in checks.items() if bad), None)
            self.place = self.size if self.defect else None
        path = None
        if self.defect:
            self.store.delete_file(self.own)
        else:
            path = f"{self.folder}/{hashlib.sha256(self.upload.encode()).hexdigest()}"
            self.store.move(self.own, path)
        return {"upload": self.upload, "name": self.name, "path": path, "size": self.size, "sha256": None if self.defect else self.sha.hexdigest(), "defect": self.defect, "place": self.place}


def spooled(parts: DataFrame, folder: str) -> DataFrame:
    """upload, name, path, size, sha256, defect, place of every upload; files of whole ones are in ``folder`` under names made of their upload's."""
    has = lambda name, kind: (F.col(name) if name in parts.columns else F.lit(None)).cast(kind).alias(name)
    rows = parts.filter("upload is not null and `offset` is not null").select(F.col("upload").cast("string").alias("upload"), F.col("offset").cast("long").alias("offset"), F.coalesce("data", F.lit(b"")).alias("data"), has("name", "string"), has("total", "long"), has("sha256", "string"))
    # of one offset the longest part first, equal ones side by side
    order = ["upload", "offset", F.desc(F.octet_length("data")), F.sha2("data", 256)]
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64()}[k]) for n, k in (c.split() for c in _FILES.split(", "))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        now: _File | None = None
        for batch in batches:
            for upload, offset, data, name, total, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.upload != upload:
                    if now is not None:
                        yield pa.RecordBatch.from_pylist([now.close()], schema=schema)
                    now = _File(store, path, upload)
                now.part(offset, data, name, total, wanted)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.close()], schema=schema)

    return rows.repartition("upload").sortWithinPartitions(*order).mapInArrow(write, _FILES)
