"""The pipeline's stages against their brute-force counterparts, each on its own input."""

import re

import corpus_pipeline
from test_near_dedup import brute
from test_packing import check

from weftbook.llm import quality

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").cache()
    names = docs.columns
    (_, good), (_, exact), (_, near), (_, pack) = corpus_pipeline.STAGES

    first = good(spark, docs, FOLDER)
    assert first.columns == names
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scores = {r.doc_id: r.predicted for r in quality.quality_scores(docs, labels).collect()}
    rows = {r.doc_id: r for r in first.collect()}
    assert sorted(rows) == sorted(d for d, p in scores.items() if p)
    bad = {r.doc_id for r in labels.filter("quality = 0").collect()}
    assert len(bad & set(rows)) <= 0.1 * len(bad)

    first = first.cache()
    second = exact(spark, first, FOLDER).cache()
    assert second.columns == names
    best = {}
    for r in rows.values():
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        best[key] = min(best.get(key, (1, 0)), (-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in second.collect()) == sorted(d for _, d in best.values())

    third = near(spark, second, FOLDER).cache()
    assert third.columns == names
    kept = [d for d, _, _, k in brute([(r.doc_id, r.text) for r in second.collect()]) if k]
    assert sorted(r.doc_id for r in third.collect()) == kept

    texts = {r.doc_id: r.text for r in third.collect()}
    assert check(pack(spark, third, FOLDER).collect(), texts, 2048) == 0


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, FOLDER)
    rows = corpus_pipeline.run(spark, FOLDER).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    assert all(r[1] == r[2] for r in rows)
