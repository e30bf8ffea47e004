"""Read questions over a graph, vector search, and neighbourhood walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import cosine, euclid, holds, inner
from tessera.operators.cut import cut, few
from tessera.sources.tabular import DETERMINISTIC


def find(entities: DataFrame, name: str, limit: int) -> DataFrame:
    """Entities whose name holds the text, by name and id; ``total`` counts before the limit."""
    return _page(entities.filter(holds(F.col("name"), name)), limit)


def of_type(entities: DataFrame, entity_type: str, limit: int) -> DataFrame:
    return _page(entities.filter(F.col("type") == entity_type), limit)


def _page(rows: DataFrame, limit: int) -> DataFrame:
    if limit <= 0:
        raise ValueError("the limit must be positive")
    total = rows.agg(F.count("*").alias("total"))
    return rows.select("id", "type", "name").orderBy("name", "id").limit(limit).crossJoin(F.broadcast(total))


def types(entities: DataFrame) -> DataFrame:
    return entities.groupBy("type").agg(F.count("*").alias("n"))


def describe(entities: DataFrame, node: str) -> DataFrame:
    return entities.filter(F.col("id") == node).select("id", "type", "name", "attributes", "prov")


def first_names(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """id, name of the first record of each of the ``ids`` (column id); an empty name counts as none.

    Entities are reduced to those ids before they are aggregated, by a broadcast where the ids are few.
    """
    order = F.col("ord") if "ord" in entities.columns else F.struct("prov.source", "prov.chunk", "type", "name")
    own = entities.join(few(ids.select("id").distinct()), "id", "left_semi")
    return own.groupBy("id").agg(F.min_by("name", order).alias("name")).filter("name <> ''")


def touching(relations: DataFrame, node: str) -> DataFrame:
    return relations.filter((F.col("from_id") == node) | (F.col("to_id") == node))


def claims(entities: DataFrame, relations: DataFrame, node: str) -> DataFrame:
    """Every edge that touches a node, once, with the ends' names (their ids where unnamed) and its source."""
    return _claimed(entities, touching(relations, node), [F.col("prov.source").alias("source"), F.col("prov.chunk").alias("chunk"), F.col("prov.producer").alias("producer")])


def assertions(entities: DataFrame, relations: DataFrame, node: str) -> DataFrame:
    """Claims with all of their provenance, one for each assertion."""
    return _claimed(entities, touching(relations, node), [F.col("prov")])


def _claimed(entities: DataFrame, edges: DataFrame, columns: list[Column]) -> DataFrame:
    ids = edges.select(F.explode(F.array("from_id", "to_id")).alias("id"))
    names = first_names(entities, ids)
    out = edges.join(names.select(F.col("id").alias("from_id"), F.col("name").alias("from_name")), "from_id", "left")
    out = out.join(names.select(F.col("id").alias("to_id"), F.col("name").alias("to_name")), "to_id", "left")
    return out.select(F.coalesce("from_name", "from_id").alias("subject"), "type", F.coalesce("to_name", "to_id").alias("object"), "from_id", "to_id", *columns).distinct()


def rendered(claims: DataFrame) -> DataFrame:
    """Claims with ``text``: ``A -[T]-> B (stated or inferred, producer) [source#chunk]``; a record without a chunk names its source only."""
    stated = F.when(F.col("producer").isin(*DETERMINISTIC), "stated").otherwise("inferred")
    place = F.concat("source", F.when(F.col("chunk") >= 0, F.concat(F.lit("#"), "chunk")).otherwise(F.lit("")))
    return claims.withColumn("text", F.concat("subject", F.lit(" -["), "type", F.lit("]-> "), "object", F.lit(" ("), stated, F.lit(", "), "producer", F.lit(") ["), place, F.lit("]")))


def contributions(entities: DataFrame, relations: DataFrame, node: str) -> DataFrame:
    """Who said something about a node: its own records, and the edges that touch it, per source, chunk and producer."""
    own = entities.filter(F.col("id") == node).select("prov.*", "name")
    edges = relations.filter((F.col("from_id") == node) | (F.col("to_id") == node)).select("prov.*", F.lit(None).cast("string").alias("name"))
    return own.unionByName(edges).groupBy("source", "chunk", "producer").agg(F.max("name").alias("name"))


def cite(chunks: DataFrame, source: str, index: int) -> DataFrame:
    if index < 0:
        raise ValueError("the record has no chunk")
    return chunks.filter((F.col("source") == source) & (F.col("idx") == index)).select("source", "idx", "text", "start_byte", "end_byte")


def unanswered(duplicates: DataFrame, about: str = "") -> DataFrame:
    """Open duplicate questions that mention a text in subject, detail or either name; all for an empty text."""
    hit = F.lit(False)
    for c in ("subject", "detail", "left_name", "right_name"):
        hit = hit | holds(F.col(c), about)
    return (duplicates.filter(hit) if about else duplicates).orderBy("subject", "detail")


def vector_search(vectors: DataFrame, query: list[float], k: int, distance: str = "cosine", vector: str = "values") -> DataFrame:
    """The ``k`` nearest rows by cosine or Euclidean distance or negative inner product; ties go to the smaller idx."""
    if k <= 0 or not query:
        raise ValueError("k and the query must not be empty")
    q = vectors.withColumn("_q", F.array(*map(F.lit, query)))
    measure: Column = {"cosine": 1 - cosine(vector, "_q"), "l2": euclid(vector, "_q"), "ip": -inner(vector, "_q")}[distance]
    return q.filter(F.size(vector) == len(query)).select("idx", measure.alias("distance")).orderBy("distance", "idx").limit(k)


def seeds_of(records: DataFrame, hits: DataFrame) -> DataFrame:
    """id: entities that were read from the chunks of search hits (source, idx)."""
    cited = records.select("id", F.col("prov.source").alias("source"), F.col("prov.chunk").alias("idx"))
    return cited.join(few(hits.select("source", "idx").distinct()), ["source", "idx"], "left_semi").select("id").distinct()


def around(seeds: DataFrame, relations: DataFrame, depth: int) -> DataFrame:
    """id, hop: nodes within ``depth`` edges of the seeds (column id), either direction, at their least hop.

    Each hop's frontier is written, and sent to the edges where it is small, so edges don't shuffle; seen nodes leave by an anti join.
    """
    seen = frontier = cut(seeds.select("id", F.lit(0).alias("hop")).distinct())
    ends = relations.select("from_id", "to_id")
    for hop in range(1, depth + 1):
        here = few(frontier.select("id"))
        out = ends.join(here, F.col("from_id") == F.col("id"), "left_semi").select(F.col("to_id").alias("id"))
        back = ends.join(here, F.col("to_id") == F.col("id"), "left_semi").select(F.col("from_id").alias("id"))
        frontier = cut(out.unionByName(back).distinct().join(seen, "id", "left_anti").select("id", F.lit(hop).alias("hop")))
        seen = seen.unionByName(frontier)
    return seen


def subgraph(nodes: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities of ``nodes`` (id) and the edges that touch one of them."""
    ids = few(nodes.select("id").distinct())
    edges = relations.join(ids.select(F.col("id").alias("_a")), F.col("from_id") == F.col("_a"), "left")
    edges = edges.join(ids.select(F.col("id").alias("_b")), F.col("to_id") == F.col("_b"), "left").filter("_a is not null or _b is not null")
    return entities.join(ids, "id", "left_semi"), edges.select(*relations.columns)


class NoLoad(LookupError):
    """The store has no such load."""


def whole(store, load_id: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of one load; raises NoLoad."""
    if not store.loads().filter((F.col("load_id") == load_id) & (F.col("state") == "complete")).limit(1).count():
        raise NoLoad(load_id)
    return store.read("entities", load_id), store.read("relations", load_id)


def index_policy(rows: int) -> tuple[str, int]:
    """How vectors should be searched: ``exact`` below 10,000 rows, else ``lists`` and how many (a thousandth, the root above a million)."""
    if rows < 10_000:
        return "exact", 0
    return "lists", max(1, rows // 1000 if rows <= 1_000_000 else int(rows**0.5))


def record_filter(rows: DataFrame, **wanted) -> DataFrame:
    """Conjunction of equalities, or memberships for lists, on columns or provenance fields."""
    for name, value in wanted.items():
        c = F.col(name if name in rows.columns else f"prov.{name}")
        rows = rows.filter(c.isin(*value) if isinstance(value, (list, tuple)) else c == value)
    return rows


def drawable(entities: DataFrame, relations: DataFrame, nodes: int, edges: int) -> tuple[DataFrame, DataFrame]:
    """The first nodes, and the first edges with both ends among them."""
    drawn = entities.orderBy("id").limit(nodes)
    ids = drawn.select("id")
    kept = relations.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return drawn, kept.orderBy("from_id", "type", "to_id").limit(edges)


def trust(relations: DataFrame, refused: DataFrame) -> DataFrame:
    """``grade`` of each relation: verified if reviewed, refused if violated, self_consistent if read from a
    structured source, else asserted. ``refused`` has from_id, type, to_id."""
    bad = refused.select("from_id", "type", "to_id").distinct().withColumn("_bad", F.lit(True))
    reviewed = F.coalesce(F.col("reviewed_by"), F.lit("")) != "" if "reviewed_by" in relations.columns else F.lit(False)
    grade = F.when(reviewed, "verified").when(F.col("_bad"), "refused").when(F.col("prov.producer").isin("ddl", "graph-import", "tabular"), "self_consistent").otherwise("asserted")
    return relations.join(bad, ["from_id", "type", "to_id"], "left").withColumn("grade", grade).drop("_bad")


def weakest(graded: DataFrame) -> DataFrame:
    """The least established grade of each edge."""
    rank = F.array_position(F.array(*map(F.lit, ("refused", "asserted", "self_consistent", "verified"))), F.col("grade"))
    return graded.groupBy("from_id", "type", "to_id").agg(F.min_by("grade", rank).alias("grade"))

