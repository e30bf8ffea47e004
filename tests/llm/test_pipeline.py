"""The pipeline against plain Python, stage by stage, on a small table."""

import re

import corpus_pipeline
from tessera.llm import pii
from tessera.llm.encode import load_tokenizer
from tests.llm.test_near_dedup import plain_components

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()} if name != "packing" else docs.collect())
    start = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    clean, exact, near, redacted, pieces = kept
    assert set(clean) <= set(start) and len(clean) > 0.8 * len(start)
    norm = {}
    for i in sorted(clean):
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", clean[i]), i)
    assert set(exact) == set(norm.values())
    parts = plain_components(sorted(exact.items()), 5, 80)
    assert {str(i) for i in near} == {i for i, n, c in parts if i == c}
    assert redacted == {i: pii.redact(t, pii.find(t)) for i, t in near.items()}
    ids = [str(i) for i in redacted]
    assert {str(r["doc_id"]) for r in pieces} == set(ids)
    sizes = {i: len(e.ids) + 1 for i, e in zip(redacted, load_tokenizer(corpus_pipeline.BYTE_BPE).encode_batch_fast(list(redacted.values()), add_special_tokens=False), strict=True)}
    assert {r["doc_id"]: r["doc_tokens"] for r in pieces} == sizes
    assert sum(r["length"] for r in pieces) == sum(sizes.values())
