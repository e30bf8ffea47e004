"""Mappings of tables inferred from what their columns hold, with the reasons and what else each column could be.

Statistics of all columns come from one aggregation over the whole table: filled, distinct and longest cells, and how many look like
numbers. Names count as hints, never as proof. A mapping that a model proposes is read from its reply and checked the same way. Every
decision is a guess row (column, read_as, alternatives, why) for the review queue.

Nulls and blank cells are unfilled. A table without rows, or without a filled column, gives no mapping.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.replies import decoded
from tessera.sources.tabular import Mapping, RelationColumn

#: A column is a key if so large a share of its filled cells differ; the distinct count is approximate, to 1 %.
UNIQUE = 0.98


@dataclass(frozen=True)
class Column_:
    """What one column holds."""

    name: str
    rows: int
    filled: int
    distinct: int
    longest: int
    numeric: int

    @property
    def unique(self) -> bool:
        return self.filled == self.rows > 0 and self.distinct >= UNIQUE * self.filled


@dataclass(frozen=True)
class Guess:
    column: str
    read_as: str
    alternatives: tuple[str, ...]
    why: str


def words(name: str) -> list[str]:
    """Words of a column name: at underscores, other signs and changes of case."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name)]


def singular(word: str) -> str:
    """An English noun's singular, by its ending."""
    low = word.lower()
    if low.endswith("ies") and len(low) > 4:
        return word[:-3] + "y"
    if low.endswith(("ches", "shes", "xes", "zes", "sses")):
        return word[:-2]
    return word[:-1] if low.endswith("s") and not low.endswith(("ss", "us", "is")) and len(low) > 3 else word


def camel(name: str) -> str:
    return "".join(w.capitalize() for w in words(name))


def profile(df: DataFrame) -> list[Column_]:
    """Statistics of every column, from one pass over all rows."""
    aggregates = [F.count("*").alias("rows")]
    for i, c in enumerate(df.columns):
        cell = F.trim(F.col(f"`{c}`").cast("string"))
        full = cell != ""
        aggregates += [F.count_if(full).alias(f"f{i}"), F.approx_count_distinct(F.when(full, cell), 0.01).alias(f"d{i}"), F.max(F.char_length(cell)).alias(f"l{i}"), F.count_if(cell.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$")).alias(f"n{i}")]
    row = df.agg(*aggregates).first()
    return [Column_(c, row["rows"], row[f"f{i}"], row[f"d{i}"], row[f"l{i}"] or 0, row[f"n{i}"]) for i, c in enumerate(df.columns)]


def infer(table: str, columns: list[Column_], targets: list[str] = ()) -> tuple[Mapping, list[Guess]]:
    """A mapping of a table and the guesses behind it; ``targets`` are known entity types that a key may refer to."""
    filled = [c for c in columns if c.filled]
    keys = [c for c in filled if c.unique]
    if not keys:
        raise ValueError(f"{table}: no column names its rows")
    kind = camel(singular(table))
    hints = lambda c: [w for w in words(c.name) if w in ("id", "key", "code", "no", "number", "uuid")] or [w for w in words(c.name) if w.endswith(("key", "id"))]
    key = min(keys, key=lambda c: (not hints(c), columns.index(c)))
    guesses = [Guess(key.name, "id", tuple(c.name for c in keys if c is not key), f"{key.distinct} different cells in {key.rows} rows")]
    texts = [c for c in filled if c is not key and c.numeric < c.filled]
    name = next((c for c in texts if set(words(c.name)) & {"name", "title", "label"}), None)
    if name:
        guesses.append(Guess(name.name, "name", ("attribute",), "the column's name says so"))
    known = {t.lower(): t for t in targets}
    relations, attributes = [], {}
    for c in filled:
        if c in (key, name):
            continue
        stem = re.sub(r"(id|key|code)$", "", words(c.name)[-1]) if words(c.name) else ""
        whole = "".join(w for w in words(c.name) if w not in ("id", "key", "code"))
        target = known.get(stem) or known.get(singular(whole)) if hints(c) else None
        if target:
            relations.append(RelationColumn(c.name, f"HAS_{target.upper()}", target))
            guesses.append(Guess(c.name, f"reference to {target}", ("attribute",), "the column's name ends like a key of a known type"))
        else:
            attributes[c.name] = "_".join(words(c.name)) or c.name
            guesses.append(Guess(c.name, "attribute", ("reference",) if hints(c) else (), "nothing says that it refers to something"))
    return Mapping(kind, key.name, name.name if name else None, attributes, tuple(relations)), guesses


def mapping_of(reply: str, columns: list[str]) -> tuple[Mapping, list[Guess]]:
    """A model's mapping from its reply; columns that are not there, or are used twice, are refused."""
    found = json.loads(decoded(reply) or "{}")
    mapping = Mapping(
        (found.get("entity_type") or "").strip(), (found.get("id_column") or "").strip(), (found.get("name_column") or "").strip() or None,
        {c: a or c for c, a in (found.get("attributes") or {}).items()},
        tuple(RelationColumn(r["column"].strip(), r["relation_type"].strip(), r["target_type"].strip()) for r in found.get("relations") or []))
    mapping.check(columns)
    reasons = found.get("reasons") or {}
    used = [(mapping.id_column, "id"), (mapping.name_column, "name"), *((c, "attribute") for c in mapping.attributes), *((r.column, f"reference to {r.target_type}") for r in mapping.relations)]
    return mapping, [Guess(c, what, (), reasons.get(c, "the model gave no reason")) for c, what in used if c]


def rendered(guesses: list[Guess]) -> list[str]:
    """Lines that people read: what a column was read as, why, and what else it could be."""
    return [f"{g.column}: {g.read_as} ({g.why})" + (f"; or {', '.join(g.alternatives)}" if g.alternatives else "") for g in guesses]
