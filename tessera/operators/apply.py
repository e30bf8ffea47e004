"""Review decisions applied to a graph: who is stamped, what goes, what is edited, and the counts after it.

Records are named by ``ref``, a hash of their identity and provenance, so a decision about one source's record never acts on
another's. Items name records in ``targets`` (item_id, ref). Decisions have item_id, verb, by, and the fields of an edit
(edit_type, edit_name, edit_from, edit_to; null where unchanged); answers of rules come along with by_rule and rule.

A set of decisions has one result, whatever its order: a removal beats an edit, two different edits of one record are refused, of several
reviewers of a record that of the greatest item_id is stamped. Everything is an equality join on ``ref``; nothing is collected but
the first offenders of a refused set. Nulls count as empty texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import review, verify

# Verbs, and those that change a record.
VERBS = ["accept", "reject", "edit", "always"]
EDITS = ["edit_type", "edit_name", "edit_from", "edit_to"]


class BadDecisions(ValueError):
    """Decisions that cannot mean what they say; the first of each kind are named."""


def entity_ref(prov: str = "prov") -> Column:
    """Name of an entity record: its type is part of what it claims."""
    return F.sha2(F.to_json(F.struct(F.lit("entity").alias("kind"), "id", "type", F.col(prov).alias("prov"))), 256)


def relation_ref(prov: str = "prov") -> Column:
    return F.sha2(F.to_json(F.struct(F.lit("relation").alias("kind"), "from_id", "type", "to_id", "key", F.col(prov).alias("prov"))), 256)


def subjects(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """subject, ref, source, chunk, producer: every way in which an item may name a record.

    An edge is named with its arrow, without one (a direction is the question there), and both again with its key.
    """
    def edge(arrow: bool, key: bool) -> Column:
        kind = F.concat("type", F.lit("#"), "key") if key else F.col("type")
        if arrow:
            return F.concat("from_id", F.lit(" -["), kind, F.lit("]-> "), "to_id")
        return F.concat(F.least("from_id", "to_id"), F.lit(" -["), kind, F.lit("]- "), F.greatest("from_id", "to_id"))

    who = [F.col(f"prov.{c}").alias(c) for c in ("source", "chunk", "producer")]
    names = F.array_compact(F.array(edge(True, False), edge(False, False), F.when(F.col("key") != "", edge(True, True)), F.when(F.col("key") != "", edge(False, True))))
    edges = relations.select(F.explode(names).alias("subject"), relation_ref().alias("ref"), *who)
    return entities.select(F.col("id").alias("subject"), entity_ref().alias("ref"), *who).unionByName(edges).distinct()


def targets(items: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """item_id, ref, attr: the records that items (item_id, subject, source, chunk, producer) are about.

    Only records of the item's own provenance. A subject that names no record is read as ``record.attribute``.
    """
    names, own = subjects(entities, relations), ["subject", "source", "chunk", "producer"]
    whole = items.join(names, own).select("item_id", "ref", F.lit(None).cast("string").alias("attr"))
    rest = items.join(whole.select("item_id").distinct(), "item_id", "left_anti").filter(F.instr("subject", ".") > 0)
    attr = F.element_at(F.split("subject", r"\."), -1)
    rest = rest.withColumn("attr", attr).withColumn("subject", F.expr("left(subject, char_length(subject) - char_length(attr) - 1)"))
    return whole.unionByName(rest.join(names, own).select("item_id", "ref", "attr"))


def decided(queue: DataFrame, decisions: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per answered item: item_id, kind, verb, by, the edit, by_rule, rule.

    ``queue`` has item_id, kind, shape; ``rules`` shape, verb, by, name, authored, ord. An item that somebody decided is
    theirs; of equal repeated decisions one counts.
    """
    from tessera.operators.queue import matched

    said = ["verb", "by", *EDITS]
    own = decisions.groupBy("item_id").agg(F.min(F.struct(*said)).alias("own"))
    rows = matched(queue, rules).join(own, "item_id", "left").filter("own is not null or rule is not null")
    by_rule = F.col("own").isNull()
    pick = lambda c: F.when(by_rule, F.col(f"rule.{c}") if c in ("verb", "by") else F.lit(None).cast("string")).otherwise(F.col(f"own.{c}")).alias(c)
    return rows.select("item_id", "kind", *[pick(c) for c in said], by_rule.alias("by_rule"), F.when(by_rule, F.col("rule.name")).alias("rule"))


def refuse_bad(queue: DataFrame, decisions: DataFrame, aimed: DataFrame) -> None:
    """Raise BadDecisions: unknown items and verbs, unsigned ones, empty edits, two answers to one item, mappings edited, nothing to act on."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    edits = F.concat_ws("", *EDITS)
    rows = decisions.join(queue.select("item_id", "kind"), "item_id", "left").join(aimed.select("item_id").distinct().withColumn("aimed", F.lit(True)), "item_id", "left")
    checks = {
        "unknown_item": F.col("kind").isNull(),
        "unknown_verb": ~F.coalesce(F.col("verb").isin(*VERBS), F.lit(False)),
        "unsigned": blank("by"),
        "empty_edit": (F.col("verb") == "edit") & (edits == ""),
        "guess": (F.col("kind") == "guess") & F.col("verb").isin("reject", "edit"),
        "no_record": F.col("aimed").isNull() & F.col("verb").isin("reject", "edit") & (F.col("kind") != "guess"),
    }
    each = rows.select("item_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))).alias("defect"))
    answers = decisions.groupBy("item_id").agg(F.count_distinct(F.to_json(F.struct("verb", "by", *EDITS))).alias("n")).filter("n > 1")
    each = each.unionByName(answers.select("item_id", F.lit("two_answers").alias("defect")))
    found = each.groupBy("defect").agg(F.min("item_id").alias("item_id")).orderBy("defect").collect()  # one row a kind
    if found:
        raise BadDecisions("; ".join(f"{r['defect']}: {r['item_id']}" for r in found))


def plan(answers: DataFrame, aimed: DataFrame) -> DataFrame:
    """One row per record that somebody or a rule answered about: ref, remove, asked, stamp, ruled_by and the edit.

    Raises BadDecisions where two items edit one record differently.
    """
    rows = answers.join(aimed.select("item_id", "ref").distinct(), "item_id")
    edits = rows.filter(F.col("verb").isin("edit", "always") & (F.concat_ws("", *EDITS) != "")).groupBy("ref").agg(F.count_distinct(F.to_json(F.struct(*EDITS))).alias("n"), *[F.first(c).alias(c) for c in EDITS])
    two = edits.filter("n > 1").limit(1).count()
    if two:
        raise BadDecisions("two items edit one record differently")
    out = rows.groupBy("ref").agg(
        F.bool_or(F.col("verb") == "reject").alias("remove"), F.bool_or(~F.col("by_rule")).alias("asked"), F.max_by("by", "item_id").alias("stamp"),
        F.array_join(F.array_sort(F.collect_set("rule")), ", ").alias("ruled_by"))
    return out.join(edits.drop("n"), "ref", "left")


def appended(names: Column, more: Column) -> Column:
    """A comma-separated list of names with those of another that it does not have yet."""
    parts = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ", "), lambda x: x != "")
    return F.array_join(F.array_union(parts(names), parts(more)), ", ")


def _marked(rows: DataFrame) -> DataFrame:
    for c, by in (("reviewed_by", "stamp"), ("ruled_by", "_ruled")):
        have = F.col(c) if c in rows.columns else F.lit("")
        rows = rows.withColumn(c, appended(have, F.col(by)))
    return rows


def apply(entities: DataFrame, relations: DataFrame, steps: DataFrame, merges: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, dropped) after ``steps`` (see ``plan``), and after ``merges`` (id, into) if there are any.

    Edges of a removed entity go with it. ``dropped`` is one row, n: records that went by a rule alone.
    """
    steps = steps.withColumnRenamed("ruled_by", "_ruled")
    e = entities.withColumn("ref", entity_ref()).join(steps, "ref", "left").withColumn("_gone", F.coalesce("remove", F.lit(False)))
    gone = e.filter("_gone").select("id").distinct()
    r = relations.withColumn("ref", relation_ref()).join(steps, "ref", "left").withColumn("_gone", F.coalesce("remove", F.lit(False)))
    for end in ("from_id", "to_id"):
        r = r.join(gone.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")), end, "left").withColumn("_gone", F.col("_gone") | F.coalesce(f"_{end}", F.lit(False)))
    unread = lambda rows: rows.filter("_gone and not coalesce(asked, false)").select("ref")
    dropped = unread(e).unionByName(unread(r)).agg(F.count("*").alias("n"))
    own = [*entities.columns, *(c for c in ("reviewed_by", "ruled_by") if c not in entities.columns)]
    edges = [*relations.columns, *(c for c in ("reviewed_by", "ruled_by") if c not in relations.columns)]
    kept = _marked(e.filter("not _gone")).withColumns({"type": F.coalesce("edit_type", "type"), "name": F.coalesce("edit_name", "name")}).select(*own)
    links = _marked(r.filter("not _gone")).withColumns({"type": F.coalesce("edit_type", "type"), "from_id": F.coalesce("edit_from", "from_id"), "to_id": F.coalesce("edit_to", "to_id")}).select(*edges)
    if merges is not None:
        kept, links = review.merge_into(kept, links, merges)
    return kept, links, dropped


def recount(entities: DataFrame, relations: DataFrame, prior: DataFrame, dropped: DataFrame) -> DataFrame:
    """``prior`` counts (one row) with what the reviewed graph holds; dropped records add up over reviews."""
    now = verify.counts(entities, relations)
    before = prior.select(*[c for c in prior.columns if c not in now.columns and c != "dropped"], (F.col("dropped") if "dropped" in prior.columns else F.lit(0)).alias("_before"))
    return before.crossJoin(now).crossJoin(dropped.select(F.col("n").alias("_n"))).withColumn("dropped", F.col("_before") + F.col("_n")).drop("_before", "_n")


def batch(queue: DataFrame, decisions: DataFrame, closed: DataFrame) -> DataFrame:
    """item_id, verdict of a batch of decisions: ``unknown_item`` and ``closed`` (``closed`` has job_id) refuse one by one, the rest is ``taken``.

    ``queue`` and ``decisions`` have job_id and item_id.
    """
    known = queue.select("job_id", "item_id").distinct().withColumn("known", F.lit(True))
    rows = decisions.select("job_id", "item_id").distinct().join(known, ["job_id", "item_id"], "left").join(closed.select("job_id").distinct().withColumn("shut", F.lit(True)), "job_id", "left")
    return rows.select("job_id", "item_id", F.when(F.col("shut"), "closed").when(F.col("known").isNull(), "unknown_item").otherwise("taken").alias("verdict"))
