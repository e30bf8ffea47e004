"""The check of a graph as one stage: canonical types, violations, conflicts, duplicates, proposals and counts.

Nothing is dropped from the graph. ``entities`` have id, type, name, attributes (JSON), prov and ``ord``, and ``aliases`` where there are any;
``relations`` have from_id, type, to_id, key, attributes, prov and ``ord``. A vocabulary is two small tables written by
people: entity types (name, attributes) and relation types (name, from_types, to_types, both_ways, at_most_one_in,
at_most_one_out). Every part is a lazy DataFrame over the canonical records; keys are aggregated before they are
joined, and no list of a key's records is ever built.

Nulls count as empty texts. Ties go to the smallest ``ord``, a total order. An empty graph has empty parts and counts of 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import affixes, fold, fold_key
from tessera.operators import verify

# Kinds of proposals and signals of duplicates in the order in which people read them.
PROPOSALS = ["entity", "relation", "attribute", "relation_ends"]
SIGNALS = ["alias", "name_across_producers", "name_affix"]
RESERVED = "note"


@dataclass
class Vocabulary:
    """Declared types. ``ontology`` names them; it is empty where nobody named any."""

    entity_types: DataFrame
    relation_types: DataFrame
    ontology: str = ""

    def governs(self) -> bool:
        """Rules hold where an ontology is named or a type declared: under a name, an empty vocabulary refuses everything."""
        return bool(self.ontology) or not self.entity_types.isEmpty() or not self.relation_types.isEmpty()


@dataclass
class Report:
    entities: DataFrame
    relations: DataFrame
    violations: DataFrame
    conflicts: DataFrame
    duplicates: DataFrame
    proposals: DataFrame
    counts: DataFrame


def stamped(records: DataFrame, ontology: str) -> DataFrame:
    """Records whose provenance names the ontology, where it named none and has the field."""
    if not ontology or "ontology" not in records.schema["prov"].dataType.names:
        return records
    blank = F.coalesce(F.col("prov.ontology"), F.lit("")) == ""
    return records.withColumn("prov", F.col("prov").withField("ontology", F.when(blank, ontology).otherwise(F.col("prov.ontology"))))


_VIOLATION = ["kind", "id", "from_id", "type", "to_id", "attr", "source", "producer", "ord"]


def _violation(rows: DataFrame, kind: str, *, node: bool, attr: str | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    ends = {"id": F.col("id") if node else none, "from_id": none if node else F.col("from_id"), "to_id": none if node else F.col("to_id"), "attr": F.col(attr) if attr else none}
    values = {"kind": F.lit(kind), "type": F.col("type"), "source": F.col("prov.source"), "producer": F.col("prov.producer"), "ord": F.col("ord"), **ends}
    return rows.select(*[values[c].alias(c) for c in _VIOLATION])


def entity_violations(entities: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``unknown_entity_type`` and ``unknown_attribute``; types that declare no attributes are open."""
    known = F.broadcast(vocabulary.entity_types.select(fold(F.col("name")).alias("_f"), F.transform("attributes", fold).alias("_a")))
    rows = entities.join(known, fold(F.col("type")) == F.col("_f"), "left")
    unknown = _violation(rows.filter("_f is null"), "unknown_entity_type", node=True)
    used = rows.filter("size(_a) > 0").withColumn("attr", F.explode(F.array_sort(F.coalesce(F.json_object_keys("attributes"), F.array().cast("array<string>")))))
    extra = used.filter(~F.array_contains("_a", fold(F.col("attr"))) & (fold(F.col("attr")) != RESERVED))
    return unknown.unionByName(_violation(extra, "unknown_attribute", node=True, attr="attr"))


def relation_violations(relations: DataFrame, entities: DataFrame, vocabulary: Vocabulary | None) -> DataFrame:
    """``dangling_relation`` (with any vocabulary or none), ``unknown_relation_type`` and ``relation_not_allowed``.

    An edge with a missing end is not also reported as not allowed.
    """
    ends = verify.with_ends(relations, entities)
    out = _violation(ends.filter("from_type is null or to_type is null"), "dangling_relation", node=False)
    if vocabulary is None:
        return out
    types = vocabulary.relation_types
    known = F.broadcast(types.select(fold(F.col("name")).alias("_f"), F.transform("from_types", fold).alias("_from"), F.transform("to_types", fold).alias("_to"), "both_ways"))
    declared = F.broadcast(vocabulary.entity_types.agg(F.collect_set(fold(F.col("name"))).alias("_known")))
    rows = ends.join(known, fold(F.col("type")) == F.col("_f"), "left").crossJoin(declared)

    def fits(side: str, end: str) -> Column:
        # no listed type means any declared one
        return F.array_contains(F.when(F.size(side) == 0, F.col("_known")).otherwise(F.col(side)), fold(F.col(end)))

    good = (fits("_from", "from_type") & fits("_to", "to_type")) | (F.col("both_ways") & fits("_from", "to_type") & fits("_to", "from_type"))
    bad = rows.filter(F.col("_f").isNotNull() & F.col("from_type").isNotNull() & F.col("to_type").isNotNull() & ~good)
    return out.unionByName(_violation(rows.filter("_f is null"), "unknown_relation_type", node=False)).unionByName(_violation(bad, "relation_not_allowed", node=False))


def entity_type_conflicts(entities: DataFrame) -> DataFrame:
    """Each distinct later type (folded) of an id that differs from its first one, once."""
    return verify.value_conflicts(entities.select("id", F.col("type").alias("value"), "ord"), ["id"], "entity_type")


_EDGE = ["low", "high", "type", "edge_key", "up"]


def edge_claims(relations: DataFrame) -> DataFrame:
    """What records say about attributes of edges: low, high, type, edge_key, up (the direction), attr, sure, value, ord."""
    rows = verify.parallel_keys(relations)
    cells = F.from_json("attributes", "map<string,string>")
    rows = rows.select(F.col("_lo").alias("low"), F.col("_hi").alias("high"), "type", "edge_key", (F.col("from_id") == F.col("_lo")).alias("up"), verify.deterministic().alias("sure"), "ord", F.explode(cells).alias("attr", "value"))
    return rows.filter("value is not null")


def relation_attribute_conflicts(claims: DataFrame) -> DataFrame:
    """``relation_attributes``: of records of one edge, direction and standing, each later value that differs (folded) from the first."""
    return verify.value_conflicts(claims, [*_EDGE, "attr", "sure"], "relation_attributes")


def relation_attribute_contradictions(claims: DataFrame) -> DataFrame:
    """``contradiction`` of a stated and an inferred value (as written) of one edge, direction and attribute, once.

    It is found with the earliest record that differs from the first one of the other standing before it; the stated
    value is the left one.
    """
    keys = [*_EDGE, "attr"]
    slot = lambda sure: F.min(F.when(F.col("sure") == F.lit(sure), F.struct("ord", "value")))
    firsts = claims.groupBy(*keys).agg(slot(True).alias("stated"), slot(False).alias("inferred")).filter("stated is not null and inferred is not null")
    rows = claims.join(firsts, keys)
    other = F.when(F.col("sure"), F.col("inferred")).otherwise(F.col("stated"))
    rows = rows.filter((other["ord"] < F.col("ord")) & (other["value"] != F.col("value")))
    sides = F.struct("ord", F.when(F.col("sure"), F.col("value")).otherwise(other["value"]).alias("left_value"), F.when(F.col("sure"), other["value"]).otherwise(F.col("value")).alias("right_value"))
    found = rows.groupBy(*keys).agg(F.min(sides).alias("c"))
    return found.select(F.lit("contradiction").alias("kind"), *keys, "c.left_value", "c.right_value", "c.ord")


def duplicates(entities: DataFrame) -> DataFrame:
    """rank, signal, left_id, right_id, ord: pairs of entities that may be one, each asked once; (rank, ord, place) is their order.

    Of several signals of a pair the one found first holds: by the later entity, then same name, alias, affix. A same-name
    signal is also asked where the pair was found first the other way round.
    """
    held = verify.first_holders(entities)
    rows = entities.withColumn("_t", fold_key(F.col("type"))).withColumn("_n", fold_key(F.col("name")))
    found = lambda r, stage, place: r.select(F.col("held.id").alias("left_id"), F.col("id").alias("right_id"), F.struct("ord", F.lit(stage).alias("stage"), place.cast("int").alias("place")).alias("at"))
    same = rows.filter("_n <> ''").join(held, ["_t", "_n"]).filter("id <> held.id and prov.producer <> held.producer")
    out = found(same, 0, F.lit(0))
    if "aliases" in entities.columns:
        named = rows.select("id", "ord", "_t", F.posexplode("aliases").alias("place", "_a")).withColumn("_n", fold_key(F.col("_a"))).filter("_n <> ''")
        out = out.unionByName(found(named.join(held, ["_t", "_n"]).filter("id <> held.id"), 1, F.col("place")))
    # affixes are made once a name, then met by all entities of that name
    stems = held.select("_t", F.col("_n").alias("_whole"), F.posexplode(affixes(F.col("_n"))).alias("place", "_n")).join(held, ["_t", "_n"]).select("_t", F.col("_whole").alias("_n"), "place", "held")
    out = out.unionByName(found(rows.join(stems, ["_t", "_n"]).filter("id <> held.id"), 2, F.col("place")))
    pair = ["low", "high"]
    each = out.groupBy("left_id", "right_id").agg(F.min("at").alias("at"), F.min(F.when(F.col("at.stage") == 0, F.col("at"))).alias("same"))
    each = each.withColumns({"low": F.least("left_id", "right_id"), "high": F.greatest("left_id", "right_id")})
    first = each.groupBy(*pair).agg(F.min_by(F.struct("left_id", "at"), F.struct("at", "left_id")).alias("f"))
    both = each.join(first, pair)
    way = F.col("left_id") == F.col("f.left_id")
    both = both.withColumn("at", F.when(way, F.col("at")).otherwise(F.col("same"))).filter("at is not null")
    signal = F.get(F.array(*[F.lit(s) for s in ("name_across_producers", "alias", "name_affix")]), F.col("at.stage"))
    both = both.withColumn("signal", signal)
    return both.select(F.array_position(F.array(*map(F.lit, SIGNALS)), F.col("signal")).cast("int").alias("rank"), "signal", "left_id", "right_id", "at.ord", "at.place")


def proposals(violations: DataFrame, entities: DataFrame) -> DataFrame:
    """What the violations ask to declare: kind_no, kind, type, records, from_types, to_types, sources, producers, example.

    One row for each undeclared entity or relation type, undeclared attribute (``from_types`` are the types that have it) and
    relation type used between further ends. Ends whose own type is undeclared are left out.
    """
    rows = violations.filter(F.col("kind") != "dangling_relation")
    kind = F.when(F.col("kind") == "unknown_entity_type", "entity").when(F.col("kind") == "unknown_relation_type", "relation").when(F.col("kind") == "unknown_attribute", "attribute").otherwise("relation_ends")
    rows = rows.withColumn("asks", kind).withColumn("what", F.when(F.col("asks") == "attribute", F.col("attr")).otherwise(F.col("type")))
    known = lambda c: F.array_sort(F.collect_set(F.when(c != "", c)))
    about = F.coalesce("id", F.concat_ws(" ", "from_id", F.lit("->"), "to_id"))
    facts = rows.groupBy("asks", "what").agg(
        F.count("*").alias("records"), known(F.col("source")).alias("sources"),
        known(F.when(F.col("asks") != "attribute", F.col("producer"))).alias("producers"), F.min_by(about, "ord").alias("example"))
    # few types have many records: ends are distinct before they are joined, by id, and types are compared once each
    said = rows.filter("asks = 'attribute'").select("asks", "what", F.lit(True).alias("first"), F.col("type").alias("_type"))
    end = lambda first, c: F.struct(F.lit(first).alias("first"), F.col(c).alias("id"))
    ends = rows.filter("asks in ('relation', 'relation_ends')").select("asks", "what", F.inline(F.array(end(True, "from_id"), end(False, "to_id")))).filter("id is not null").distinct()
    types = entities.groupBy("id").agg(F.max_by("type", "ord").alias("_type"))
    met = ends.join(types, "id").select("asks", "what", "first", "_type").unionByName(said).distinct()
    undeclared = violations.filter("kind = 'unknown_entity_type'").select(F.col("type").alias("_u")).distinct()
    met = met.join(undeclared, F.col("_type") == F.col("_u"), "left_anti")
    sides = met.groupBy(F.col("asks").alias("_asks"), F.col("what").alias("_what")).agg(known(F.when(F.col("first"), F.col("_type"))).alias("from_types"), known(F.when(~F.col("first"), F.col("_type"))).alias("to_types"))
    none = F.array().cast("array<string>")
    out = facts.join(sides, (F.col("asks") == F.col("_asks")) & F.col("what").eqNullSafe(F.col("_what")), "left")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("from_types", "to_types")})
    place = F.array_position(F.array(*map(F.lit, PROPOSALS)), F.col("asks")).cast("int")
    return out.select(place.alias("kind_no"), F.col("asks").alias("kind"), F.col("what").alias("type"), "records", "from_types", "to_types", "sources", "producers", "example")


def counts(entities: DataFrame, relations: DataFrame, violations: DataFrame, conflicts: DataFrame, duplicates: DataFrame, **further: DataFrame) -> DataFrame:
    """One row: how many of each there are, with the deterministic and inferred relations; ``further`` parts count under their names."""
    out = verify.counts(entities, relations)
    for name, part in {"violations": violations, "conflicts": conflicts, "duplicates": duplicates, **further}.items():
        out = out.crossJoin(part.agg(F.count("*").alias(name)))
    return out


def _conflict(rows: DataFrame, owner: str, subject: Column, left: Column, right: Column) -> DataFrame:
    return rows.select("kind", subject.alias("subject"), left.cast("string").alias("left_value"), right.cast("string").alias("right_value"), "ord", F.col(owner).alias("owner"))


def edge_subject(low: str, kind: str, high: str, key: str, arrow: Column) -> Column:
    """An edge as people read it; its key is named where siblings are told apart."""
    label = F.concat(F.lit("-["), kind, F.when(F.col(key) != "", F.concat(F.lit("#"), key)).otherwise(F.lit("")), F.lit("]-"))
    return F.concat(low, F.lit(" "), F.when(arrow, F.lit("")).otherwise(F.lit("<")), label, F.when(arrow, F.lit(">")).otherwise(F.lit("")), F.lit(" "), high)


def conflicts(entities: DataFrame, relations: DataFrame, relation_types: DataFrame | None = None) -> DataFrame:
    """All conflicts as kind, subject, left_value, right_value, ord.

    Direction is a question only for types that are declared and run one way; cardinality only for types that say so.
    """
    return owned_conflicts(entities, relations, relation_types).drop("owner")


def owned_conflicts(entities: DataFrame, relations: DataFrame, relation_types: DataFrame | None = None) -> DataFrame:
    """``conflicts`` with ``owner``: the node whose own records and relations are all that the conflict depends on.

    That is the entity itself, the lesser end of a pair, or the node with too many ends. Where ``relations`` have an
    ``owner`` (each relation once for each of its ends), an owner's conflicts come from its rows alone.
    """
    columns = [c for c in relations.columns if c != "owner"]
    dealt = "owner" in relations.columns
    pairs = (relations.filter(F.col("owner") == F.least("from_id", "to_id")) if dealt else relations).select(*columns)
    named = _conflict(entity_type_conflicts(entities), "id", F.col("id"), F.col("left_value"), F.col("right_value"))
    fields_ = verify.value_conflicts(verify.attribute_claims(entities), ["id", "attr"], "entity_attributes")
    claims = edge_claims(pairs)
    about = F.concat(edge_subject("low", "type", "high", "edge_key", F.col("up")), F.lit("."), "attr")
    out = named.unionByName(_conflict(fields_, "id", F.concat("id", F.lit("."), "attr"), F.col("left_value"), F.col("right_value")))
    for part in (relation_attribute_conflicts(claims), relation_attribute_contradictions(claims)):
        out = out.unionByName(_conflict(part, "low", about, F.col("left_value"), F.col("right_value")))
    if relation_types is None:
        return out
    rules = F.broadcast(relation_types.select(fold(F.col("name")).alias("_f"), "both_ways", "at_most_one_in", "at_most_one_out"))
    ways = verify.direction_conflicts(pairs.withColumn("_f", fold(F.col("type"))).join(rules, "_f").filter("not both_ways").select(*columns))
    label = F.concat(F.col("low"), F.lit(" -["), "type", F.when(F.col("edge_key") != "", F.concat(F.lit("#"), "edge_key")).otherwise(F.lit("")), F.lit("]- "), "high")
    out = out.unionByName(_conflict(ways, "low", label, F.concat_ws(" -> ", "left_from", "left_to"), F.concat_ws(" -> ", "right_from", "right_to")))
    ruled = relations.withColumn("_f", fold(F.col("type"))).join(rules, "_f")
    if dealt:
        ruled = ruled.withColumns({"at_most_one_out": F.col("at_most_one_out") & (F.col("owner") == F.col("from_id")), "at_most_one_in": F.col("at_most_one_in") & (F.col("owner") == F.col("to_id"))})
    many = verify.cardinality_of(ruled.filter("at_most_one_in or at_most_one_out"))
    return out.unionByName(_conflict(many, "node", F.concat_ws(" ", "node", "type", "side"), F.col("left_value"), F.col("right_value")))


def check(entities: DataFrame, relations: DataFrame, vocabulary: Vocabulary | None = None) -> Report:
    """The whole check. Without a vocabulary that governs, only what the records say of each other is checked."""
    rules = vocabulary if vocabulary is not None and vocabulary.governs() else None
    if rules is not None:
        entities = stamped(verify.canonical(entities, rules.entity_types), rules.ontology)
        relations = stamped(verify.canonical(relations, rules.relation_types), rules.ontology)
    broken = relation_violations(relations, entities, rules)
    if rules is not None:
        broken = entity_violations(entities, rules).unionByName(broken)
    clashes = conflicts(entities, relations, rules.relation_types if rules else None)
    twins = duplicates(entities)
    asked = proposals(broken, entities)
    return Report(entities, relations, broken, clashes, twins, asked, counts(entities, relations, broken, clashes, twins))


def disagreeing(claimed: DataFrame, derived: DataFrame) -> DataFrame:
    """field, claimed, derived of each number that two rows of counts do not share; a field that one of them lacks is not compared."""
    shared = [c for c in derived.columns if c in claimed.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"a.{c}").cast("long").alias("claimed"), F.col(f"b.{c}").cast("long").alias("derived")) for c in shared])
    both = claimed.select(F.struct(*shared).alias("a")).limit(1).crossJoin(derived.select(F.struct(*shared).alias("b")).limit(1))
    return both.select(F.explode(pairs).alias("p")).select("p.*").filter(~F.col("claimed").eqNullSafe(F.col("derived")))
