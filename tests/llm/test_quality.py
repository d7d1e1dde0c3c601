"""Quality scores: held-out accuracy, odd rows, and that labels of held-out rows are never used."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftbook.llm import quality
from weftbook.llm.queries import QUERIES


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    values = np.array(scores)[order]
    starts = np.searchsorted(values, values, "left")
    ends = np.searchsorted(values, values, "right")
    ranks[order] = (starts + ends + 1) / 2
    good = np.array(labels) == 1
    return (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op5_positive_unlabelled"](spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    held = [(rows[r.doc_id].score, r.quality) for r in labels if rows[r.doc_id].held_out]
    assert auc(*zip(*held)) > 0.97
    assert np.mean([(s >= 0.5) == (q == 1) for s, q in held]) > 0.95


@pytest.fixture(scope="module")
def small(spark):
    docs = [(i, ("good plain words come here again, number %d. " % i) * 3, "x", 1.0) for i in range(60)]
    docs += [(i, "BAD!! " * 20 + "x" * i, "x", 1.0) for i in range(60, 80)]
    docs += [(None, "no id", "x", 0.0), (5, docs[5][1], "x", 1.0), (90, None, None, None), (91, "", "", 0.0), (92, "w" * 300000, "", 0.0)]
    return spark.createDataFrame(docs, "doc_id long, text string, quality string, score double")


def test_odd_rows_and_hidden_labels(spark, small):
    labels = [(i, 1 if i < 60 else 0, 0) for i in range(0, 80, 2)] + [(None, 1, 0), (90, None, 0), (7, 1, 0), (7, 0, 0)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = quality.quality_scores(small, frame)
    rows = found.collect()
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and len(rows) == 85
    flipped = frame.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.quality_scores(small, flipped).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.score)
    a, b = sorted(rows, key=key), sorted(again, key=key)
    assert np.allclose([r.score for r in a], [r.score for r in b])
    kept = quality.keep_good(small, frame)
    assert kept.columns == small.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r.doc_id or 0 for r in rows if r.predicted)


def test_without_labels_and_without_rows(spark, small):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_scores(small, none).count() == 85
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.quality_scores(empty, none).count() == 0


def test_features_read_the_whole_text():
    assert not np.allclose(quality.features("plain " * 30000), quality.features("plain " * 29000 + "BAD!! " * 1000))
