"""The pipeline against brute force, stage by stage."""

import re

import corpus_pipeline
from tests.llm.test_ops import brute_components, brute_leaks


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    kept = corpus_pipeline.quality_filter(spark, docs, sf)
    assert kept.columns == names
    rows = {r.doc_id: r.text for r in kept.collect()}
    best = {}
    for i, t in sorted(rows.items()):
        k = re.sub(r"[\x20\x09-\x0D]", "", t)
        if k not in best or len(t) > len(rows[best[k]]):
            best[k] = i
    rows = {i: rows[i] for i in best.values()}
    rows = {i: rows[i] for i, _, c in brute_components(sorted(rows.items()), 5, 80) if i == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {i: t for i, t in rows.items() if not brute_leaks([(i, t)], items)[i]}
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    assert len(corpus_pipeline.STAGES) == 5 and 0 < len(got) < docs.count()
