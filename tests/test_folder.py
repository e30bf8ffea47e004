"""A folder of mixed files as one job."""

import json

from tessera.operators import folder, load
from tessera.sources import tabular
from tests.test_ddl import DUMP


def test_a_mixed_folder_becomes_one_load(spark, tmp_path):
    files = {
        "in/customers.csv": "customer_id,name,nation_key\n1,Ann,7\n2,Bob,8\n2,Bea,8\n,Nobody,1\n" + "1,Ann,7\n" * 9 + "3,Cy\n",
        "in/more/customers2.csv": "customer_id,name,nation_key\n4,Dan,9\n",
        "in/parts.csv": "part_id,label\n1,Bolt\n2,Nut\n",
        "in/uneven.csv": "a;b;c\n1;2\n",
        "in/yard.sql": DUMP,
        "in/open.sql": "create table t (x int /* open",
        "in/code.json": json.dumps({"nodes": [{"id": "f", "type": "file", "name": "F", "summary": "The first file."}, {"id": "g", "type": "file", "name": "G"}], "edges": [{"source": "f", "target": "g", "type": "imports"}]}),
        "in/broken.json": '{"nodes": [}',
        "in/notes.md": "# One\n\nWords here.\n\n# Two\n\nMore words.\n",
        "in/page.html": "<html><body><p>Hello &amp; bye.</p></body></html>",
        "in/paper.pdf": "%PDF-1.4 nothing",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "in/noise.bin").write_bytes(b"\x00\x01\xff")
    store = load.Store(spark, f"{tmp_path.as_uri()}/store")
    made, read = folder.import_folder(spark, store, "all", f"{tmp_path.as_uri()}/in", f"{tmp_path.as_uri()}/in/more", targets=["Nation"], mappings={"customers": tabular.Mapping("Customer", "customer_id", "name", {}, (tabular.RelationColumn("nation_key", "HAS_NATION", "Nation"),))})
    assert made.status == "written"
    base = lambda s: s.rsplit("/", 1)[-1]
    assert {base(r.source): r.kind for r in read.files.collect()} == {"customers.csv": "table", "customers2.csv": "table", "parts.csv": "table", "uneven.csv": "table", "yard.sql": "ddl", "open.sql": "ddl", "code.json": "graph", "broken.json": "graph", "notes.md": "markdown", "page.html": "html", "paper.pdf": "pdf", "noise.bin": "binary"}
    nodes = {r.id: r for r in store.read("entities", "all").collect()}
    assert {i for i in nodes if i.startswith("customer:")} == {"customer:1", "customer:2", "customer:4"} and {"table:yard.dock", "table:crane", "table:serves", "f", "g", "part:1", "nation:7", "nation:8", "nation:9"} <= set(nodes)
    assert nodes["customer:2"].name == "Bob" and base(nodes["customer:4"].prov.source) == "customers2.csv" and nodes["f"].prov.producer == "graph-import"
    edges = {(r.from_id, r.type, r.to_id) for r in store.read("relations", "all").collect()}
    assert {("customer:1", "HAS_NATION", "nation:7"), ("f", "imports", "g"), ("table:crane", "REFERENCES", "table:yard.dock")} <= edges
    assert sorted(r.kind for r in store.read("violations", "all").collect()) == ["duplicate_id", "malformed_json", "malformed_row", "missing_id"]
    chunks = sorted((r.idx, r.text.strip()) for r in store.read("chunks", "all").collect())
    assert [i for i, _ in chunks] == list(range(len(chunks))) and {"Hello & bye.", "The first file."} <= {t for _, t in chunks}
    assert {base(r.source) for r in store.read("unread", "all").collect()} == {"uneven.csv", "open.sql", "paper.pdf", "noise.bin"}
    assert {r.about: r.read_as for r in store.read("guesses", "all").collect()}== {"part_id": "id", "label": "name"}
    orders = [r.ord for r in store.read("entities", "all").collect()]
    assert len({tuple(o) for o in orders}) == len(orders)
