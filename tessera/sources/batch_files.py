"""A Python data source for stores that take batches: files bounded by rows and bytes, visible by a manifest.

``df.write.format("tessera").mode("append").save(folder)``: tasks write batches under names of their own and send them with their commit message; only the driver's
commit writes the manifest, which names what belongs to the table. A failed task or attempt leaves files that nobody names, an aborted
write leaves nothing. A folder takes one write. ``spark.read.format("tessera").load(folder)`` reads one partition per batch. Conditions given to ``read`` go to the files
as an option: batches whose ranges rule them out are no partitions. (Spark's own push-down to Python sources is not used: in 4.1.2 filters pushed for one query of a DataFrame stay
for its next ones.)

Nulls are kept. A single row above the bytes is a batch by itself. An empty table has a manifest without files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT, MANIFEST = "tessera", "manifest.json"
#: Rows and bytes of a batch unless the options ``rows`` and ``bytes`` say otherwise.
ROWS, BYTES = 5_000, 3 << 20
#: A column, one of == > >= < <= in, and a value (a list for ``in``).
Condition = tuple[str, str, object]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BatchFiles)


def read(spark: SparkSession, folder: str, *where: Condition) -> DataFrame:
    """The rows of a folder that meet all conditions, which the files and their batches' ranges answer first."""
    rows = spark.read.format(FORMAT).option("where", json.dumps(where)).load(folder)
    for name, kind, value in where:
        c = F.col(name)
        rows = rows.filter(c.isin(value) if kind == "in" else {"==": c == value, ">": c > value, ">=": c >= value, "<": c < value, "<=": c <= value}[kind])
    return rows


def _files(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


@dataclass
class Wrote(WriterCommitMessage):
    files: list[dict]


@dataclass
class Batch(InputPartition):
    name: str


def bounded(batches: Iterable[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Batches of consecutive rows, as many in each as fit in ``rows`` rows and ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    have = used = 0.0
    for batch in batches:
        each = batch.nbytes / max(1, len(batch))
        at = 0
        while at < len(batch):
            fits = min(rows - have, int((size - used) // each) if each else rows)
            if fits < 1:
                if held:
                    yield pa.concat_batches(held)
                    held, have, used = [], 0, 0.0
                    continue
                fits = 1
            part = batch.slice(at, int(fits))
            held.append(part)
            have, used, at = have + len(part), used + each * len(part), at + len(part)
    if held:
        yield pa.concat_batches(held)


def _spans(batch: pa.RecordBatch) -> dict:
    """Least and greatest value of plain columns of numbers and text."""
    out = {}
    for name, column in zip(batch.schema.names, batch.columns, strict=True):
        if pa.types.is_integer(column.type) or pa.types.is_floating(column.type) or pa.types.is_string(column.type):
            ends = pc.min_max(column).as_py()
            low, high = ends["min"], ends["max"]
            if low is not None and not (isinstance(low, float) and (low != low or high != high)) and len(str(low)) + len(str(high)) <= 200:
                out[name] = [low, high]
    return out


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.uri, self.schema = options["path"], schema.json()
        self.rows, self.bytes = int(options.get("rows", ROWS)), int(options.get("bytes", BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        store, path = _files(self.uri)
        store.create_dir(path, recursive=True)
        files = []
        for batch in bounded(iterator, self.rows, self.bytes):
            name = f"{uuid.uuid4().hex}.parquet"
            with store.open_output_stream(f"{path}/{name}") as out:
                pq.write_table(pa.Table.from_batches([batch]), out)
            files.append({"name": name, "rows": len(batch), "bytes": batch.nbytes, "spans": _spans(batch)})
        return Wrote(files)

    def commit(self, messages: list[Wrote | None]) -> None:
        store, path = _files(self.uri)
        store.create_dir(path, recursive=True)
        if store.get_file_info(f"{path}/{MANIFEST}").type != fs.FileType.NotFound:
            raise FileExistsError(f"{self.uri} has been written already")
        files = [f for m in messages if m for f in m.files]
        own = f"{path}/.{uuid.uuid4().hex}"
        with store.open_output_stream(own) as out:
            out.write(json.dumps({"schema": self.schema, "files": files}).encode())
        store.move(own, f"{path}/{MANIFEST}")
        named = {f["name"] for f in files}
        for info in store.get_file_info(fs.FileSelector(path)):
            if info.base_name.endswith(".parquet") and info.base_name not in named:
                store.delete_file(info.path)

    def abort(self, messages: list[Wrote | None]) -> None:
        """Nothing of this write stays; a folder with a manifest belongs to an earlier one, of which nothing goes."""
        store, path = _files(self.uri)
        if store.get_file_info(f"{path}/{MANIFEST}").type == fs.FileType.NotFound:
            if store.get_file_info(path).type != fs.FileType.NotFound:
                store.delete_dir(path)
            return
        for m in messages:
            for f in m.files if m else []:
                store.delete_file(f"{path}/{f['name']}")


class BatchReader(DataSourceReader):
    def __init__(self, uri: str, manifest: dict, schema: StructType, conditions: list[Condition]) -> None:
        self.uri, self.manifest, self.names, self.conditions = uri, manifest, schema.names, conditions

    def _possible(self, spans: dict) -> bool:
        for name, kind, value in self.conditions:
            if name in spans:
                low, high = spans[name]
                values = value if kind == "in" else [value]
                if not any({"==": low <= v <= high, "in": low <= v <= high, ">": high > v, ">=": high >= v, "<": low < v, "<=": low <= v}[kind] for v in values):
                    return False
        return True

    def partitions(self) -> list[Batch]:
        return [Batch(f["name"]) for f in self.manifest["files"] if self._possible(f["spans"])] or [Batch("")]

    def read(self, partition: Batch) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, path = _files(self.uri)
        test = None
        for name, kind, value in self.conditions:
            field = pc.field(name)
            one = field.isin(value) if kind == "in" else {"==": field == value, ">": field > value, ">=": field >= value, "<": field < value, "<=": field <= value}[kind]
            test = one if test is None else test & one
        with store.open_input_file(f"{path}/{partition.name}") as source:
            yield from pq.read_table(source, columns=self.names, filters=test).to_batches()


class BatchFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _manifest(self) -> dict:
        store, path = _files(self.options["path"])
        with store.open_input_stream(f"{path}/{MANIFEST}") as source:
            return json.loads(source.read())

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self._manifest()["schema"]))

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(dict(self.options), schema)

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(self.options["path"], self._manifest(), schema, [tuple(c) for c in json.loads(self.options.get("where", "[]"))])
