"""Loading a graph: integrity checks before it, and a store whose readers see complete loads only."""

from __future__ import annotations

import datetime
import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.text import framed, same_text
from tessera.operators.cut import few
from tessera.operators.txlog import Conflict, Log


def entity_defects(entities: DataFrame) -> DataFrame:
    """Once per repeated id: ``entity_corroborated`` if the second record has the first one's type and name, else ``entity_id_reused``. An empty id is refused, once."""
    w = Window.partitionBy("id").orderBy("ord")
    two = entities.withColumn("_at", F.row_number().over(w)).filter("_at <= 2").groupBy("id").agg(F.count("*").alias("_n"), F.min_by(F.struct("type", "name"), "ord").alias("a"), F.max_by(F.struct("type", "name"), "ord").alias("b")).filter("_n = 2")
    same = same_text(F.col("a.type"), F.col("b.type")) & same_text(F.col("a.name"), F.col("b.name"))
    out = two.filter(F.col("id").cast("string") != "").select(F.when(same, "entity_corroborated").otherwise("entity_id_reused").alias("kind"), F.col("id").cast("string").alias("id"), F.when(same, "report").otherwise("refuse").alias("severity"))
    blank = entities.filter(F.coalesce(F.col("id").cast("string"), F.lit("")) == "").limit(1)
    return out.unionByName(blank.select(F.lit("entity_id_reused").alias("kind"), F.lit("").alias("id"), F.lit("refuse").alias("severity")))


def chunk_defects(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("idx").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("chunk_index_reused").alias("kind"), "idx")


def vector_defects(vectors: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """``chunk_vectored_twice``, ``vector_empty``, ``vector_without_chunk`` (where the graph has chunks) and ``vector_width`` (against the first vector)."""
    out = vectors.groupBy("chunk").count().filter("count > 1").select(F.lit("chunk_vectored_twice").alias("kind"), "chunk")
    out = out.unionByName(vectors.filter("size(values) = 0").select(F.lit("vector_empty").alias("kind"), "chunk"))
    if chunks is not None:
        out = out.unionByName(vectors.join(chunks.select(F.col("idx").alias("chunk")), "chunk", "left_anti").select(F.lit("vector_without_chunk").alias("kind"), "chunk"))
    first = "ord" if "ord" in vectors.columns else "chunk"
    width = F.broadcast(vectors.agg(F.min_by(F.size("values"), first).alias("_w")))
    return out.unionByName(vectors.filter("size(values) > 0").crossJoin(width).filter("size(values) <> _w").select(F.lit("vector_width").alias("kind"), "chunk"))


def citation_defects(records: DataFrame, chunks: DataFrame) -> DataFrame:
    cited = records.filter("prov.chunk >= 0").select(F.col("prov.chunk").alias("idx")).distinct()
    return cited.join(chunks.select("idx"), "idx", "left_anti").select(F.lit("provenance_without_chunk").alias("kind"), "idx")


def corroborated(entities: DataFrame) -> DataFrame:
    """First record per id, with the number of the others."""
    w = Window.partitionBy("id").orderBy("ord")
    return entities.withColumn("_at", F.row_number().over(w)).withColumn("others", F.count("*").over(Window.partitionBy("id")) - 1).filter("_at = 1").drop("_at")


def paired(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with their vector, the last one where there are several."""
    last = vectors.groupBy(F.col("chunk").alias("idx")).agg(F.max_by("values", "ord").alias("values"))
    return chunks.join(last, "idx", "left")


def digest(records: dict[str, DataFrame]) -> str:
    """Content name of a graph, independent of order and of repeats' places.

    Each record is one JSON line with its kind. A line's SHA-256 is read as eight 32-bit words, and each word is summed
    over all lines as an exact decimal: partial sums are small, and one row reaches the driver at every size. The
    name is the SHA-256 of the sums and the number of lines.
    """
    import hashlib

    lines = None
    for kind, df in sorted(records.items()):
        one = df.select(F.sha2(F.concat(framed(F.lit(kind)), framed(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))), 256).alias("h"))
        lines = one if lines is None else lines.unionByName(one)
    words = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"w{i}") for i in range(8)]
    row = lines.agg(F.count("*").alias("n"), *words).first()
    return hashlib.sha256(",".join(str(v or 0) for v in row).encode()).hexdigest()


class Held(Exception):
    """A load that the store refuses."""


@dataclass(frozen=True)
class Loaded:
    """What became of a load: ``written`` or ``converged``, under which name, and how many repeated entity records were folded."""

    status: str
    load_id: str
    digest: str
    corroborated: int


#: Seconds after which the files of a load that was never finished may be removed.
ABANDONED = 86_400
_ENTRY = "load_id string, digest string, version string, state string, dimension int, model string, parts map<string,string>, rows map<string,long>, at string"
_PROV = "struct<source:string,chunk:int,producer:string,model:string,ontology:string,chunking:string,confidence:double,reviewed_by:string,rule_set:string,ruled_by:string,by:string,at:string>"
#: Columns of the kinds of records, for kinds that no load has yet.
RECORDS = {
    "entities": f"id string, type string, name string, attributes string, aliases array<string>, prov {_PROV}, ord long, others long",
    "relations": f"from_id string, type string, to_id string, key string, attributes string, prov {_PROV}, ord long",
    "chunks": "idx int, text string, source string, strategy string, heading string, start_byte long, end_byte long",
    "vectors": "chunk int, values array<float>, model string, ord long",
    "violations": "kind string, subject string, detail string, ord long",
    "conflicts": "kind string, subject string, left_value string, right_value string, ord long",
    "duplicates": "signal string, subject string, detail string, left_id string, right_id string, left_name string, right_name string",
    "guesses": "about string, read_as string, alternatives array<string>, why string",
    "unread": "source string, locator string, reason string",
    "supersessions": "retired string, by string, at string, note string",
    "rule_sets": "name string, rule string",
}


class Store:
    """Parquet folders per kind and version, and a transaction log that says which version each load has.

    A load first logs its intent, writes its records to folders of a new version, checks and digests what was written, and then commits the
    version under its name; the commit makes it visible, so readers see the old or the new graph, whole. Plans of the records run once. Of two
    writers at once, one that meets the other's change of the same name, content or vector width decides anew. Names stand in the log only,
    so any text is a name. Replaced and deleted versions, and those of loads that died, stay until ``sweep``.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.log = Log(spark, root)

    def _entries(self, version: int | None = None) -> DataFrame:
        rows = self.log.state(version).filter(F.col("key").startswith("load/"))
        return rows.select(F.from_json("value", _ENTRY).alias("r"), F.col("version").alias("number")).select("r.*", "number")

    def loads(self) -> DataFrame:
        """One row per load that is there: load_id, digest, version, state, dimension, model, parts, rows, at, number (of its commit)."""
        return self._entries().withColumns({"parts": F.array_sort(F.map_keys("parts")), "at": F.col("at").cast("timestamp")})

    def history(self) -> DataFrame:
        """number, load_id, done (``begun``, ``written``, ``deleted`` or ``given up``) and rows by kind of everything that happened to loads, as far back as the log goes."""
        rows = self.log.history().filter(F.col("key").startswith("load/") | F.col("key").startswith("writing/"))
        entry, writing = F.from_json("value", _ENTRY), F.col("key").startswith("writing/")
        told = rows.withColumn("e", entry).withColumn("first", F.first("e.load_id").over(Window.partitionBy("key").orderBy("version")))
        finished = F.col("value").isNull() & writing
        done = F.when(writing, "begun").when(F.col("value").isNull(), "deleted").otherwise("written")
        # a writer's own commit ends its intent too: only an end without a load in the same commit is one given up
        committed = told.filter(~writing).select("version").distinct().withColumn("_c", F.lit(True))
        told = told.join(committed, "version", "left").filter(~(finished & F.coalesce("_c", F.lit(False))))
        return told.select(F.col("version").alias("number"), F.coalesce("e.load_id", "first").alias("load_id"), F.when(finished, "given up").otherwise(done).alias("done"), "e.rows")

    def _path(self, kind: str, version: str) -> str:
        return f"{self.root}/{kind}/{version}"

    def load(self, load_id: str, records: dict[str, DataFrame], replace: bool = False) -> Loaded:
        """Store a graph under a name, or under one made of its content where the name is empty.

        Defects that lose data refuse it (``preflight.refuse``), all named. The same content is not kept twice,
        whatever its name. Another graph under the name, or vectors of another width or model than the store holds, refuse it
        too, unless ``replace`` says that this load is to be exchanged.
        """
        from tessera.operators import preflight

        version = uuid.uuid4().hex
        intent = f"writing/{version}"
        self.log.commit({intent: json.dumps({"load_id": load_id, "at": time.time()})})
        try:
            written, rows = {}, {}
            for kind, df in records.items():
                df.write.parquet(self._path("staged" if kind == "entities" else kind, version))
                written[kind] = self.spark.read.schema(df.schema).parquet(self._path("staged" if kind == "entities" else kind, version))
            preflight.refuse(written)
            name = digest(written)
            load_id = load_id or f"ld_{name[:24]}"
            first = corroborated(written["entities"])
            first.write.parquet(self._path("entities", version))
            self.log.folder.remove(f"staged/{version}")
            parts = {k: df.schema.json() for k, df in written.items()} | {"entities": first.schema.json()}
            kept = {k: self.spark.read.schema(StructType.fromJson(json.loads(v))).parquet(self._path(k, version)) for k, v in parts.items()}
            rows = {k: df.count() for k, df in kept.items()}
            folded = kept["entities"].agg(F.sum("others").alias("n")).first()["n"] or 0
            width = self._width(kept.get("vectors"))
            while True:
                try:
                    return self._finish(load_id, name, version, replace, parts, rows, folded, width)
                except Conflict:
                    continue
        except BaseException:
            self._give_up(version, [*records, "staged"])
            raise

    def _finish(self, load_id: str, name: str, version: str, replace: bool, parts: dict, rows: dict, folded: int, width: tuple[int, str]) -> Loaded:
        """Decide on the newest snapshot whether the written version becomes the load, and commit that."""
        seen = self.log.version()
        mine, content, intent = f"load/{load_id}", f"content/{name}", f"writing/{version}"
        state = {r["key"]: r["value"] for r in self.log.state(seen).filter(F.col("key").isin(mine, content, intent)).collect()}
        if intent not in state:
            raise Held("this load was swept as abandoned")
        if content in state:
            self._give_up(version, list(parts))
            return Loaded("converged", json.loads(state[content])["load_id"], name, folded)
        if mine in state and not replace:
            raise Held(f"{load_id} holds a different graph")
        dimension, model = width
        changes = {content: json.dumps({"load_id": load_id}), intent: None}
        if dimension:
            changes["vectors"] = json.dumps({"dimension": dimension, "model": model})
            other = self._entries(seen).filter((F.col("load_id") != load_id) & (F.col("dimension") > 0)).limit(1).collect()
            if other and (other[0]["dimension"], other[0]["model"]) != width:
                raise Held(f"vectors are {dimension} wide by {model!r}, the store holds {other[0]['dimension']} by {other[0]['model']!r}")
        if mine in state:
            changes[f"content/{json.loads(state[mine])['digest']}"] = None
        at = datetime.datetime.now(datetime.UTC).isoformat()
        changes[mine] = json.dumps({"load_id": load_id, "digest": name, "version": version, "state": "complete", "dimension": dimension, "model": model, "parts": parts, "rows": rows, "at": at})
        self.log.commit(changes, seen)
        return Loaded("written", load_id, name, folded)

    def _give_up(self, version: str, kinds: list[str]) -> None:
        self.log.commit({f"writing/{version}": None})
        for kind in kinds:
            self.log.folder.remove(f"{kind}/{version}")

    @staticmethod
    def _width(vectors: DataFrame | None) -> tuple[int, str]:
        """Width and model of a load's vectors."""
        if vectors is None:
            return 0, ""
        model = F.min("model") if "model" in vectors.columns else F.lit("")
        row = vectors.agg(F.max(F.size("values")).alias("width"), model.alias("model")).first()
        return (0, "") if row["width"] is None else (row["width"], row["model"] or "")

    def delete(self, load_id: str) -> bool:
        """Make a load invisible; False if it is not there."""
        while True:
            seen = self.log.version()
            there = self.log.state(seen).filter(F.col("key") == f"load/{load_id}").collect()
            if not there:
                return False
            try:
                self.log.commit({f"load/{load_id}": None, f"content/{json.loads(there[0]['value'])['digest']}": None}, seen)
                return True
            except Conflict:
                continue

    def sweep(self, abandoned: float = ABANDONED) -> int:
        """Remove the folders of versions that no load names and no writer is at work on; returns how many.

        A writer whose intent is older than ``abandoned`` seconds loses it first, so it can't commit any more. Folders are listed before the log is read, and
        an intent is logged before any folder is made: whatever a writer has begun by then is known.
        """
        found = [(kind, v) for kind in self.log.folder.names() if kind != "log" for v in self.log.folder.names(kind)]
        seen = self.log.version()
        writing = self.log.state(seen).filter(F.col("key").startswith("writing/")).collect()
        late = {r["key"]: None for r in writing if json.loads(r["value"])["at"] <= time.time() - abandoned}
        if late:
            try:
                seen = self.log.commit(late, seen)
            except Conflict:
                return self.sweep(abandoned)
        busy = {r["key"].removeprefix("writing/") for r in writing if r["key"] not in late}
        named = {r["version"] for r in self._entries(seen).select("version").toLocalIterator()} | busy
        gone = [(kind, v) for kind, v in found if v not in named]
        for kind, v in gone:
            self.log.folder.remove(f"{kind}/{v}")
        return len(gone)

    def read(self, kind: str, load_id: str | None = None) -> DataFrame:
        """Records of complete loads (or of one) with their load_id; only their own folders are listed and read.

        Loads with other columns are united by name. A kind that no load has is an empty table.
        """
        rows = self._entries().select("load_id", "version", F.col("parts")[kind].alias("part"))
        rows = rows.filter("part is not null")
        loads = (rows.filter(F.col("load_id") == load_id) if load_id is not None else rows).collect()
        if not loads:
            like = rows.limit(1).collect()
            empty = self.spark.createDataFrame([], StructType.fromJson(json.loads(like[0]["part"]))) if like else self.spark.createDataFrame([], RECORDS.get(kind, "load_id string"))
            return empty.withColumn("load_id", F.lit(None).cast("string"))
        names = {l["version"]: l["load_id"] for l in loads}
        out = None
        for part in sorted({l["part"] for l in loads}):
            versions = sorted(l["version"] for l in loads if l["part"] == part)
            schema = StructType.fromJson(json.loads(part))
            got = self.spark.read.schema(schema).parquet(*[self._path(kind, v) for v in versions])
            if len(versions) == 1:
                got = got.withColumn("load_id", F.lit(names[versions[0]]))
            else:
                version = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
                table = self.spark.createDataFrame([(v, names[v]) for v in versions], "_version string, load_id string")
                got = got.select("*", version.alias("_version")).join(few(table), "_version").drop("_version")
            out = got if out is None else out.unionByName(got, allowMissingColumns=True)
        return out
