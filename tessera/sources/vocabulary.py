"""Vocabularies written by people: read from JSON, checked, extended by accepted proposals.

A document names its version (``name@version``) and has parts (prose, code, tabular, schema), each with entity types (name, attributes,
description) and relation types (name, from, to, both_ways, at_most_one_in, at_most_one_out, description). They are hundreds of names written
by hand, so they live on the driver and become small tables that Spark broadcasts. An empty end list is open: it holds between any
declared types, and is never opened or closed by accident.
"""

from __future__ import annotations

import json
from copy import deepcopy

from pyspark.sql import SparkSession

from tessera.operators.check import PROPOSALS, Vocabulary

# Fixed values of the format.
PARTS = ["code", "prose", "schema", "tabular"]
ENTITY_FIELDS = ["name", "attributes", "description"]
RELATION_FIELDS = ["name", "from", "to", "both_ways", "at_most_one_in", "at_most_one_out", "description"]


class BadVocabulary(ValueError):
    """The document, or a change to it, is refused; the message says where."""


def _fold(name: str) -> str:
    return name.strip().lower()


def check_id(name: str) -> None:
    head, at, version = name.strip().partition("@")
    if not (head.strip() and at and version.strip()):
        raise BadVocabulary(f"{name!r} must be written name@version")


def load(text: str) -> dict:
    """The document of a JSON text, checked whole."""
    try:
        doc = json.loads(text)
    except ValueError as e:
        raise BadVocabulary(f"no JSON: {e}") from e
    check(doc)
    return doc


def _fields(found: dict, allowed: list[str], where: str) -> None:
    # a misspelled field would leave its list empty, and an empty end is open
    unknown = sorted(set(found) - set(allowed))
    if unknown:
        raise BadVocabulary(f"{where}: unknown field {unknown[0]!r}")


def check(doc: dict) -> None:
    _fields(doc, ["id", "parts"], "document")
    check_id(doc.get("id") or "")
    if not doc.get("parts"):
        raise BadVocabulary("no parts are declared")
    for part in sorted(doc["parts"]):
        where, v = f"part {part!r}", doc["parts"][part]
        if part not in PARTS:
            raise BadVocabulary(f"{where} is unknown; parts are {', '.join(PARTS)}")
        _fields(v, ["entities", "relations"], where)
        if not v.get("entities"):
            raise BadVocabulary(f"{where} declares no entity types")
        seen: dict[str, set[str]] = {"entities": set(), "relations": set()}
        for kind, allowed in (("entities", ENTITY_FIELDS), ("relations", RELATION_FIELDS)):
            for t in v.get(kind) or []:
                name = (t.get("name") or "").strip()
                _fields(t, allowed, f"{where}: {name!r}")
                if not name:
                    raise BadVocabulary(f"{where}: a type of {kind} has no name")
                if _fold(name) in seen[kind]:
                    raise BadVocabulary(f"{where} declares {name!r} twice")
                seen[kind].add(_fold(name))
        for r in v.get("relations") or []:
            for end in [*(r.get("from") or []), *(r.get("to") or [])]:
                if _fold(end) not in seen["entities"]:
                    raise BadVocabulary(f"{where}: {r['name']!r} names the end {end!r}, which is not declared")


def tables(spark: SparkSession, doc: dict, part: str) -> Vocabulary:
    """One part as the two tables of ``operators.check``."""
    if part not in doc["parts"]:
        raise BadVocabulary(f"part {part!r} is not declared")
    v = doc["parts"][part]
    nodes = [(t["name"].strip(), list(t.get("attributes") or [])) for t in v["entities"]]
    edges = [(t["name"].strip(), list(t.get("from") or []), list(t.get("to") or []), *(bool(t.get(f)) for f in ("both_ways", "at_most_one_in", "at_most_one_out"))) for t in v.get("relations") or []]
    return Vocabulary(
        spark.createDataFrame(nodes, "name string, attributes array<string>"),
        spark.createDataFrame(edges, "name string, from_types array<string>, to_types array<string>, both_ways boolean, at_most_one_in boolean, at_most_one_out boolean"),
        doc["id"],
    )


def next_id(name: str) -> str:
    head, _, version = name.partition("@")
    if not version.isdigit():
        raise BadVocabulary(f"{name!r} has no number to count on; say what the new id is")
    return f"{head}@{int(version) + 1}"


def _joined(have: list[str], more: list[str]) -> list[str]:
    seen, out = {_fold(x) for x in have}, list(have)
    for x in more:
        if _fold(x) not in seen:
            seen.add(_fold(x))
            out.append(x)
    return out


def extend(doc: dict, part: str, accepted: list[dict], by: str, at: str, new_id: str = "") -> tuple[dict, list[str]]:
    """(the document with the accepted proposals under a new id, what was added); the given one is left as it is.

    Proposals are rows of ``check.proposals`` as dicts. A relation without an observed end, an attribute without a declared
    type, and a widening of an end that is open (it would narrow it) are refused. What is declared already is skipped.
    """
    if not by.strip():
        raise BadVocabulary("nobody is named for the change")
    if part not in doc["parts"]:
        raise BadVocabulary(f"part {part!r} is not declared")
    out, added = deepcopy(doc), []
    out["id"] = new_id or next_id(doc["id"])
    check_id(out["id"])
    v = out["parts"][part]
    nodes, edges = v["entities"], v.setdefault("relations", [])
    named = lambda types, name: next((t for t in types if _fold(t["name"]) == _fold(name)), None)
    for p in accepted:
        kind, name, ends = p.get("kind"), p["type"], (list(p.get("from_types") or []), list(p.get("to_types") or []))
        told = f"accepted by {by} on {at}, {p.get('records', 0)} records"
        if kind == PROPOSALS[0]:
            if named(nodes, name) is None:
                nodes.append({"name": name, "description": told})
                added.append(name)
        elif kind == PROPOSALS[1]:
            if named(edges, name) is not None:
                continue
            if not all(ends):
                raise BadVocabulary(f"{name!r} was seen without a declared end: accept the entity types first")
            edges.append({"name": name, "from": ends[0], "to": ends[1], "description": told})
            added.append(name)
        elif kind == PROPOSALS[2]:
            missing = [t for t in ends[0] if named(nodes, t) is None]
            if missing or not ends[0]:
                raise BadVocabulary(f"the attribute {name!r} has no declared type to stand in: {missing}")
            for t in ends[0]:
                holder = named(nodes, t)
                wider = _joined(holder.get("attributes") or [], [name])
                if wider != (holder.get("attributes") or []):
                    holder["attributes"] = wider
                    added.append(f"{holder['name']}.{name}")
        elif kind == PROPOSALS[3]:
            rule = named(edges, name)
            if rule is None or not any(ends):
                raise BadVocabulary(f"{name!r} cannot be widened: it is not declared, or no end was seen")
            if any(seen and not rule.get(end) for end, seen in zip(("from", "to"), ends, strict=True)):
                raise BadVocabulary(f"{name!r} is open at one end: accepting this would narrow it")
            wider = [_joined(rule.get(end) or [], seen) for end, seen in zip(("from", "to"), ends, strict=True)]
            if wider != [rule.get("from") or [], rule.get("to") or []]:
                rule["from"], rule["to"] = wider
                rule["description"] = f"{rule.get('description', '')} widened, {told}".strip()
                added.append(name)
        else:
            raise BadVocabulary(f"the proposal for {name!r} has no kind")
    check(out)
    return out, sorted(added)


def prompt(doc: dict, part: str) -> str:
    """What a model is told of the types: each with its ends, in the order of the document."""
    v = doc["parts"][part]
    lines = ["Use only these entity types:", *(f"- {t['name']}" + (f" ({', '.join(t['attributes'])})" if t.get("attributes") else "") for t in v["entities"])]
    if v.get("relations"):
        lines += ["Use only these relation types:", *(f"- {r['name']}: {' | '.join(r.get('from') or ['any'])} -> {' | '.join(r.get('to') or ['any'])}" for r in v["relations"])]
    return "\n".join(lines)
