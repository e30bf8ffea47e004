"""The review queue: questions, their shapes, rules that answer whole shapes, decisions and what stays open.

Items have kind, subject, type, producer, model, ``ord`` and kind's own fields. A shape keeps what a reviewer
relied on (kind, type, rule or field, producer, model) and drops the instance (ids, ends, chunk),
so one rule answers all items alike; a rule matches whole shapes only. Items of any number stay
distributed: rules meet them by an equality join on the shape, and Catalyst picks its form by size.

Nulls count as empty texts. Ties go to the smallest ``ord``. Without items or rules all results are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import framed

# Kinds of items in queue order, and what authored rules may say.
KINDS = ["conflict", "violation", "guess", "low_confidence", "duplicate"]
VERBS = ["always", "reject"]
AUTHORED_SIGNAL = "name_affix"


def shape(kind: Column, what: Column, left: tuple[Column, Column], right: tuple[Column, Column] | None = None, about: Column | None = None) -> Column:
    """Text form of a class of items: kind, what it says, the type it is about, and who produced each side.

    Fields are percent-encoded, so a separator inside a value cannot make two shapes equal.
    """
    def safe(c: Column) -> Column:
        return F.url_encode(F.coalesce(c.cast("string"), F.lit("")))

    def who(side: tuple[Column, Column]) -> Column:
        return F.concat_ws("@", *[safe(c) for c in side])

    parts = [safe(kind), safe(what), safe(about if about is not None else F.lit("")), who(left)]
    if right is not None:
        # the two sides of a pair are named in a fixed order, whichever came first
        parts[-1] = F.concat_ws("|", F.least(who(left), who(right)), F.greatest(who(left), who(right)))
    return F.concat_ws("/", *parts)


def build(items: DataFrame, rules: DataFrame, reviewing: bool) -> DataFrame:
    """The queue: columns of ``items`` with item_id and kind_no; (kind_no, ord, item_id) is its order.

    Conflicts are always asked about. Other kinds are when reviewing; duplicates also where a rule covers
    them. Items whose names are equal are told apart by #2, #3 and so on.
    """
    covered = items.join(first_rules(rules).select(F.col("shape").alias("_s")), F.col("shape") == F.col("_s"), "left")
    asked = (F.col("kind") == "conflict") | F.lit(reviewing) | ((F.col("kind") == "duplicate") & F.col("_s").isNotNull())
    rows = covered.filter(asked).drop("_s").withColumn("kind_no", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int"))
    base = F.concat_ws(":", "kind", F.coalesce("subject", F.lit("")))
    nth = F.row_number().over(Window.partitionBy("kind", "subject").orderBy("ord"))
    return rows.withColumn("item_id", F.when(nth == 1, base).otherwise(F.concat_ws("#", base, nth)))


def first_rules(rules: DataFrame) -> DataFrame:
    """Of the rules of one shape the first; rules without a shape answer nothing."""
    row = F.struct(*[c for c in rules.columns if c != "shape"])
    return rules.filter("shape <> ''").groupBy("shape").agg(F.min_by(row, "ord").alias("rule"))


def matched(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Items with the ``rule`` that covers them, null where none does. An authored rule never answers a conflict."""
    seen = rules.filter("not coalesce(authored, false)")
    conflicts = items.filter("kind = 'conflict'").join(first_rules(seen), "shape", "left")
    others = items.filter("kind <> 'conflict'").join(first_rules(rules), "shape", "left")
    return conflicts.unionByName(others)


def decision_defects(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """``unknown_item`` for each decision on nothing, ``two_decisions`` for each item decided in two ways."""
    said = decisions.groupBy("item_id").agg(F.count_distinct(F.struct(F.coalesce("verb", F.lit("")), F.coalesce("edit", F.lit("")))).alias("n"))
    unknown = said.join(queue.select("item_id"), "item_id", "left_anti").select("item_id", F.lit("unknown_item").alias("kind"))
    return unknown.unionByName(said.filter("n > 1").select("item_id", F.lit("two_decisions").alias("kind")))


def resolve(queue: DataFrame, decisions: DataFrame, rules: DataFrame) -> DataFrame:
    """item_id, kind, subject, verb, by, via: a person's decision, else that of the rule, else null."""
    own = decisions.groupBy("item_id").agg(F.min_by(F.struct("verb", "by"), "ord").alias("own"))
    rows = matched(queue, rules).join(own, "item_id", "left")
    via = F.when(F.col("own").isNotNull(), "decision").when(F.col("rule").isNotNull(), "rule")
    return rows.select("item_id", "kind", "subject", F.coalesce("own.verb", "rule.verb").alias("verb"), F.coalesce("own.by", "rule.by").alias("by"), via.alias("via"))


def standing_rules(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """One rule per shape from ``always`` decisions, the first one, with the item it was made on as the reason."""
    rows = decisions.filter("verb = 'always'").select("item_id", "verb", "by", F.col("ord").alias("_ord")).join(queue.select("item_id", "shape"), "item_id")
    first = rows.groupBy("shape").agg(F.min_by(F.struct("verb", "by", F.col("item_id").alias("because"), F.col("_ord").alias("ord")), F.struct("_ord", "item_id")).alias("r"))
    return first.select("shape", "r.*", F.lit(False).alias("authored"))


def authored_defects(rules: DataFrame) -> DataFrame:
    """Why a written rule is refused; ``rules`` has name, kind, signal, producer, verb, by, because, at."""
    def blank(c: str) -> Column:
        return F.coalesce(F.trim(c), F.lit("")) == ""

    checks = {
        **{f"no_{c}": blank(c) for c in ("by", "because", "at")},
        "verb": ~F.coalesce(F.col("verb").isin(*VERBS), F.lit(False)),
        "kind": ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)),
        "conflict": F.col("kind") == "conflict",
        "signal": (F.col("kind") == "duplicate") & ~F.col("signal").eqNullSafe(AUTHORED_SIGNAL),
        "producer": F.col("producer") == "human",
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))
    return rules.select("name", F.explode(found).alias("defect"))


def rule_set(rules: DataFrame) -> DataFrame:
    """One row: rule_set (first 16 hex of a SHA-256 over the sorted distinct names and texts), n.

    ``rules`` (name, told) are written by people; they meet in one row as hashes of 64 signs each.
    """
    each = rules.select(F.sha2(F.concat(framed(F.coalesce("name", F.lit(""))), framed(F.coalesce("told", F.lit("")))), 256).alias("h")).distinct()
    return each.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "").cast("binary"), 256), 1, 16).alias("rule_set"), F.count("*").alias("n"))


def open_questions(resolved: DataFrame, reviewing: bool) -> DataFrame:
    """Items that hold a job: conflicts nobody decided, and when reviewing every item without an answer."""
    return resolved.filter(F.col("verb").isNull() & ((F.col("kind") == "conflict") | F.lit(reviewing)))


def reopened(before: DataFrame, after: DataFrame) -> DataFrame:
    """Conflicts (kind, subject) of the decided graph that were not there before the decisions."""
    key = ["kind", "subject"]
    return after.join(before.select(*key).distinct(), key, "left_anti")


def stamped(findings: DataFrame, resolved: DataFrame) -> DataFrame:
    """Findings (item_id, reviewed_by) with the reviewer's name behind those already there."""
    who = resolved.filter("verb is not null").select("item_id", F.col("by").alias("_by"))
    rows = findings.join(who, "item_id", "left")
    both = F.when(F.coalesce("reviewed_by", F.lit("")) == "", F.col("_by")).otherwise(F.concat_ws(", ", "reviewed_by", "_by"))
    return rows.withColumn("reviewed_by", F.when(F.col("_by").isNull(), F.col("reviewed_by")).otherwise(both)).drop("_by")
