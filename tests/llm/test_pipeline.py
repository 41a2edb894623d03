"""The pipeline on the smallest tables, against brute force where there is no SQL."""

import corpus_pipeline
from tests.llm.helpers import documents, edge_rows, read
from tests.llm.test_free_operators import brute_near
from tests.llm.test_native_operators import brute_contaminated


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, [(r["doc_id"], r["text"]) for r in read(sf, "documents")]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "decontaminate", "mix", "shard"]

    docs = stages["language"](spark, docs, sf)
    assert docs.columns == columns and docs.count() >= 0.98 * len(rows)
    part = brute_near(rows, 80)
    docs = stages["near_duplicates"](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert docs.columns == columns and sorted(r["doc_id"] for r in docs.collect()) == sorted(i for i, _ in rows if part[i] == i)
    leaks = {d for d, _ in brute_contaminated(read(sf, "documents"), read(sf, "benchmark"))}
    docs = stages["decontaminate"](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert docs.columns == columns and sorted(r["doc_id"] for r in docs.collect()) == sorted(i for i, _ in rows if i not in leaks)
    docs = stages["mix"](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert docs.columns == columns and 0.8 * len(rows) < docs.count() < len(rows)


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf).collect()
    ids = [r["doc_id"] for r in out]
    assert len(ids) == len(set(ids)) > 100
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_stages_on_edges(spark, sf):
    docs = documents(spark, edge_rows())
    for some in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            some = stage(spark, some, sf)
            some.count()
