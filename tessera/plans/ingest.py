"""Registered queries from texts and tables to graphs by models that stand in for real ones, and rows for other stores, with SQL twins."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.operators import extract, numbering, writers
from tessera.plans.graph import _ENT, _REL, all_entities, all_relations, query, table
from tessera.sources import assertions, chunking, ddl, infer, replies
from tessera.sources.tabular import provenance


def _reader(prompts):
    """Stands in for a model: an answer says which word begins a text and which comes next; some texts it cannot read."""
    out = []
    for p in prompts:
        mark = p.rsplit("\n", 1)[1]
        words = p.split(f"\n{mark}\n", 1)[1].rsplit(f"\n{mark}", 1)[0].split(" ")
        if len(words) % 10 == 0:
            out.append("Sorry, no.")
        else:
            pair = [{"type": "Word", "name": w} for w in words[:2]]
            out.append(json.dumps({"entities": pair, "relations": [{"from": pair[0], "type": "BEFORE", "to": pair[-1]}]}))
    return out


_TEXTS = "(SELECT item_id, string_split(text, ' ') AS w FROM benchmark)"


def _job(spark, d):
    chunks = table(spark, d, "benchmark").select(F.lit("benchmark").alias("source"), F.col("item_id").cast("int").alias("idx"), "text")
    return extract.run(chunks, _reader, "stand-in", "Find words.")


@query(f"SELECT DISTINCT 'word:' || regexp_replace(lower(x), '\\s+', ' ', 'g') AS id FROM (SELECT w[1] AS x FROM {_TEXTS} WHERE len(w) % 10 <> 0 UNION ALL SELECT w[2] FROM {_TEXTS} WHERE len(w) % 10 <> 0)")
def extract_entities(spark, d):
    return _job(spark, d).graph["entities"].select("id")


@query(f"SELECT DISTINCT 'word:' || regexp_replace(lower(w[1]), '\\s+', ' ', 'g') AS from_id, 'word:' || regexp_replace(lower(w[2]), '\\s+', ' ', 'g') AS to_id FROM {_TEXTS} WHERE len(w) % 10 <> 0")
def extract_relations(spark, d):
    return _job(spark, d).graph["relations"].select("from_id", "to_id")


@query(f"SELECT item_id AS idx, CASE WHEN len(w) % 10 = 0 THEN 'unread' ELSE 'read' END AS outcome FROM {_TEXTS}")
def extract_accounts(spark, d):
    return _job(spark, d).accounts.select(F.col("idx").cast("long").alias("idx"), "outcome")


@query(f"""WITH e AS (SELECT DISTINCT lower(x) AS id FROM (SELECT w[1] AS x FROM {_TEXTS} WHERE len(w) % 10 <> 0 UNION ALL SELECT w[2] FROM {_TEXTS} WHERE len(w) % 10 <> 0)), r AS (SELECT DISTINCT lower(w[1]) AS a, lower(w[2]) AS b FROM {_TEXTS} WHERE len(w) % 10 <> 0)
SELECT (SELECT count(*) FROM e) AS entities, (SELECT count(*) FROM r) AS relations, CAST(0 AS BIGINT) AS violations, (SELECT count(*) FROM {_TEXTS}) AS chunks, (SELECT count(*) FROM {_TEXTS} WHERE len(w) % 10 = 0) AS chunks_unread""")
def pipeline_graph(spark, d):
    """From texts to a stored load; the counts read back are those that follow from the graph."""
    import uuid

    from tessera.operators.cut import cut
    from tessera.operators.load import Store

    cut(spark.range(1))  # names the shared folder
    store = Store(spark, f"{spark.sparkContext.getCheckpointDir()}/graph-{uuid.uuid4().hex}")
    extract.stored(_job(spark, d), store, "job")
    return store.read("counts", "job").select("entities", "relations", "violations", "chunks", "chunks_unread")


@query("SELECT item_id AS k, row_number() OVER (ORDER BY text, item_id) - 1 AS n FROM benchmark")
def numbered_chunks(spark, d):
    return numbering.numbered(table(spark, d, "benchmark").select(F.col("item_id").alias("k"), "text"), ["text", "k"], "n").select("k", "n")


@query("""SELECT 'person:' || CASE event_id % 2 WHEN 0 THEN 'user ' ELSE 'visitor ' END || user_id AS from_id, upper(event_type) AS type, 'day:' || strftime(ts, '%Y-%m-%d') AS to_id, 'clerk ' || event_id % 5 AS person FROM events WHERE event_id % 5 <> 0""")
def asserted_relations(spark, d):
    rows = table(spark, d, "events").select(F.lit(" Person").alias("subject_type"), F.concat(F.when(F.col("event_id") % 2 == 0, "User  ").otherwise("Visitor "), "user_id").alias("subject"), F.upper("event_type").alias("predicate"), F.lit("Day").alias("object_type"), F.date_format("ts", "yyyy-MM-dd").alias("object"), F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("clerk "), F.col("event_id") % 5)).alias("by"), F.lit("2024-02-01").alias("at"), F.lit(None).cast("string").alias("note"))
    return assertions.asserted(rows, "desk")[1].select("from_id", "type", "to_id", F.col("prov.by").alias("person"))


@query("SELECT * FROM (VALUES ('c_custkey', 'id'), ('c_name', 'name'), ('c_nationkey', 'reference to Nation'), ('c_acctbal', 'attribute'), ('c_mktsegment', 'attribute')) t(col, read_as)")
def inferred_mapping(spark, d):
    """The mapping of customers, inferred from all their cells."""
    _, guesses = infer.infer("customers", infer.profile(table(spark, d, "customer")), ["Nation", "Region"])
    return spark.createDataFrame([(g.column, g.read_as) for g in guesses], "col string, read_as string")


@query("SELECT 'doc' || doc_id AS source, 0 AS idx, text, CAST(0 AS BIGINT) AS start_byte, CAST(octet_length(encode(text)) AS BIGINT) AS end_byte FROM documents WHERE text IS NOT NULL AND trim(text) <> ''")
def chunk_whole(spark, d):
    """Whole texts: the size is no limit here."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("source"), "text")
    return chunking.chunks(docs, chunking.Options("whole", 10_000_000)).select("source", "idx", "text", "start_byte", "end_byte")


@query("""WITH t AS (SELECT item_id, text, length(text) AS n FROM benchmark WHERE length(text) = octet_length(encode(text))) SELECT 'b' || item_id AS source, i::INTEGER AS idx, text[i * 400 + 1 : least(n, (i + 1) * 400)] AS text FROM (SELECT item_id, replace(text, ' ', '.') AS text, n FROM t), range(0, 1000) r(i) WHERE i * 400 < n""")
def chunk_fixed(spark, d):
    """ASCII texts without words, so that no cut moves to a word's edge: 100 tokens are 400 signs."""
    docs = table(spark, d, "benchmark").filter("char_length(text) = octet_length(text)").select(F.concat(F.lit("b"), "item_id").alias("source"), F.replace("text", F.lit(" "), F.lit(".")).alias("text"))
    dots = docs.withColumn("text", F.regexp_replace("text", "[A-Za-z0-9_'-]", "#"))
    spans = chunking.chunks(dots, chunking.Options("fixed", 100, 0)).select("source", "idx", "start_byte", "end_byte")
    return spans.join(docs, "source").select("source", "idx", F.expr("substring(text, cast(start_byte as int) + 1, cast(end_byte - start_byte as int))").alias("text"))


@query("SELECT 'Word' AS type, item_id::INTEGER AS chunk, 'word ' || item_id AS name, item_id % 4 = 0 AS unread FROM benchmark")
def reply_entities(spark, d):
    """Replies in several states of repair, one of which holds nothing."""
    i = F.col("item_id")
    name = F.concat(F.lit("word "), i)
    good = F.concat(F.lit('{"entities": [{"type": "Word", "name": "'), name, F.lit('"}]}'))
    text = F.when(i % 4 == 0, "nothing").when(i % 4 == 1, F.concat(F.lit("Here: "), good, F.lit(" {x}"))).when(i % 4 == 2, F.replace(good, F.lit("}]}"), F.lit("},]}"))).otherwise(F.replace(good, F.lit('"'), F.lit("'")))
    rows = table(spark, d, "benchmark").select(F.lit("b").alias("source"), i.cast("int").alias("chunk"), F.lit("m").alias("model"), text.alias("text"), name.alias("name"))
    got = replies.read_replies(rows)
    read = got.entities.select("type", F.col("prov.chunk").alias("chunk"), "name", F.lit(False).alias("unread"))
    lost = got.unread.select(F.regexp_extract("locator", r"(\d+)", 1).cast("int").alias("chunk"))
    return read.unionByName(lost.select(F.lit("Word").alias("type"), "chunk", F.concat(F.lit("word "), "chunk").alias("name"), F.lit(True).alias("unread")))


@query(f"SELECT from_id, type, to_id, '{{\"prov_load\":\"L\",\"prov_producer\":\"tabular\",\"prov_source\":\"' || source || '\"}}' AS properties FROM {_REL}")
def store_property_edges(spark, d):
    edges = all_relations(spark, d).withColumn("attributes", F.lit("{}"))
    out = writers.property_edges(edges, "L")
    return out.select("from_id", "type", "to_id", F.to_json("properties").alias("properties"))


@query(f"SELECT id, type AS label, name, source FROM {_ENT}")
def store_property_nodes(spark, d):
    out = writers.property_nodes(all_entities(spark, d), "L")
    p = F.col("properties")
    return out.select("id", F.col("labels")[1].alias("label"), p["name"].alias("name"), p["prov_source"].alias("source"))


@query("SELECT 'order:' || l_orderkey AS from_id, 'supplier:' || l_suppkey AS to_id, count(DISTINCT l_returnflag) - 1 AS merged FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag) > 1")
def store_facet_losses(spark, d):
    ends = (F.concat(F.lit("order:"), "l_orderkey").alias("from_id"), F.lit("SUPPLIED_BY").alias("type"), F.concat(F.lit("supplier:"), "l_suppkey").alias("to_id"))
    rows = table(spark, d, "lineitem").select(*ends, F.lit("").alias("key"), F.to_json(F.struct(F.col("l_returnflag").alias("flag"))).alias("attributes"), provenance("lineitem").alias("prov"), F.struct("l_linenumber", "l_partkey", "l_returnflag").alias("ord"))
    return writers.facets(rows)[1].select("from_id", "to_id", "merged")


@query(f"SELECT DISTINCT source AS document, 'relation' AS kind, from_id || ' ' || type || ' ' || to_id AS line FROM {_REL} UNION ALL SELECT source, 'entity', name || ' is a ' || type FROM {_ENT}")
def store_brain(spark, d):
    return writers.brain(all_entities(spark, d), all_relations(spark, d).withColumn("attributes", F.lit("{}")).withColumn("ord", F.struct("from_id", "to_id"))).select("document", "kind", "line")


_DUMP = "(SELECT 'd' || s_suppkey AS source, 's' || s_suppkey AS parent, 'n' || s_nationkey AS nation FROM supplier)"


def _dumps(spark, d):
    """One dump a supplier: a table, one that refers to it, and a key to a table that only some dumps declare."""
    one = F.format_string("create table s%1$d (id int primary key, -- key; of all\n name text);\ncreate table item (id int primary key, s_id int references s%1$d (id), place int);\n%2$salter table item add constraint far foreign key (place) references n%3$d (id);", "s_suppkey", F.when(F.col("s_nationkey") < 9, F.format_string("create table n%d (id int);\n", "s_nationkey")).otherwise(F.lit("")), "s_nationkey")
    return table(spark, d, "supplier").select(F.concat(F.lit("d"), "s_suppkey").alias("source"), one.alias("ddl"))


@query(f"SELECT source, 'table:' || parent AS id FROM {_DUMP} UNION ALL SELECT source, 'table:item' FROM {_DUMP} UNION ALL SELECT source, 'table:' || nation FROM {_DUMP} WHERE nation[2:]::INTEGER < 9")
def ddl_tables(spark, d):
    return ddl.import_ddl(_dumps(spark, d)).entities.select(F.col("prov.source").alias("source"), "id")


@query(f"SELECT source, 'table:item' AS from_id, 'table:' || parent AS to_id, '(s_id)' AS key FROM {_DUMP} UNION ALL SELECT source, 'table:item', 'table:' || nation, 'far' FROM {_DUMP} WHERE nation[2:]::INTEGER < 9")
def ddl_keys(spark, d):
    return ddl.import_ddl(_dumps(spark, d)).relations.select(F.col("prov.source").alias("source"), "from_id", "to_id", "key")


@query(f"SELECT source, 'dangling_relation' AS kind FROM {_DUMP} WHERE nation[2:]::INTEGER >= 9")
def ddl_findings(spark, d):
    return ddl.import_ddl(_dumps(spark, d)).findings.select("source", "kind")
