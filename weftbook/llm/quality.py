"""Quality scores by positive-unlabelled learning on figures of the whole text.

Trusted positives are documents labelled 1, the unlabelled set is the web text itself; labels 0 serve only to estimate the share
of good documents (the class prior).  With the logistic loss the unbiased risk of a linear score f is convex,

    R(f) = mean over unlabelled of log(1 + exp(f))  -  prior * mean over positives of f.

What of it stands for negatives, mean_u[log(1 + exp(f))] - prior * mean_p[log(1 + exp(f))], cannot truly be below zero; where a step
would make it so, the step is halved (the non-negative risk).  Steps are Newton's: every step needs only sums of
gradients and second derivatives, made in one pass over stored feature rows of all training documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftbook.llm.common import small_batches, stored

STEPS = 12
RIDGE = 1e-3
WINDOW = 64
MARKS = b"|!#$%&*@^~_=+<>{}[]\\/"
FEATURES = 16 + len(MARKS)
FOLDS, HELD_OUT = 3, 1

FEATURE_ROWS = "doc_id long, x array<double>"
SUMS_ARROW = pa.schema([("kind", pa.int32()), ("sums", pa.list_(pa.float64()))])

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_HIGH = np.arange(256) >= 128
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_MARKS = np.frombuffer(MARKS, np.uint8)


def features(text: str | None) -> np.ndarray:
    """Figures of a whole text; the empty text has the leading 1 only."""
    x = np.zeros(FEATURES)
    x[0] = 1.0
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return x
    size = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    n = len(words)
    distinct = len(set(words))
    again = sum(a == b for a, b in zip(words, words[1:]))
    # Repetition within stretches of equal size, so that long texts are not taken for repetitive ones.
    parts = [words[i : i + WINDOW] for i in range(0, n, WINDOW)]
    fresh = sum(len(set(p)) for p in parts) / n
    letters = max(1.0, counts[_UPPER].sum() + counts[_LOWER].sum())
    x[1] = np.log1p(n) / 10
    x[2] = min(size / n, 40) / 10
    x[3] = again / n
    x[4] = fresh
    x[5] = distinct / n
    x[6] = counts[_UPPER].sum() / letters
    x[7] = counts[_DIGIT].sum() / size
    x[8] = counts[_HIGH].sum() / size
    x[9] = counts[_BLANK].sum() / size
    x[10] = counts[10] / n
    x[11] = counts[44] / n
    x[12] = counts[46] / n
    marks = counts[_MARKS]
    x[13] = marks.sum() / n
    x[14] = min(1.0, 5 * marks.sum() / n)
    x[15] = min(1.0, 5 * again / n)
    x[16:] = np.minimum(marks / n, 3.0)
    return x


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            piece = batch.slice(at, 2000)
            rows = [features(t.as_py()) for t in piece.column("text")]
            flat = pa.array(np.concatenate(rows))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * FEATURES), flat)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), lists], ["doc_id", "x"])


def feature_rows(docs: DataFrame) -> DataFrame:
    """doc_id and the features of every row, stored once."""
    texts = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stored(texts.mapInArrow(_featured, FEATURE_ROWS), "quality-features")


def held_out() -> "F.Column":
    """Whether a row's labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    prior: float


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(-1, FEATURES)


def _sums(rows: DataFrame, weights: np.ndarray | None) -> dict[int, tuple[float, float, float, np.ndarray, np.ndarray]]:
    """Over kind 0 (unlabelled) and 1 (positives): rows, sum of log(1 + exp(f)), sum of f, gradient and curvature sums."""
    w = None if weights is None else weights.copy()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 3 + FEATURES * 2 + FEATURES * FEATURES))
        for batch in batches:
            kinds = batch.column(0).to_numpy(zero_copy_only=False)
            table = _matrix(batch.column(1))
            for kind in (0, 1):
                x = table[kinds == kind]
                f = np.zeros(len(x)) if w is None else x @ w
                p = 0.5 * (1 + np.tanh(f / 2))
                total[kind, :3] += len(x), np.logaddexp(0, f).sum(), f.sum()
                total[kind, 3 : 3 + FEATURES] += x.sum(axis=0)
                total[kind, 3 + FEATURES : 3 + 2 * FEATURES] += p @ x
                total[kind, 3 + 2 * FEATURES :] += ((x * (p * (1 - p))[:, None]).T @ x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(total))], schema=SUMS_ARROW)

    parts = rows.select("kind", "x").mapInArrow(work, "kind int, sums array<double>")
    whole = parts.select("kind", F.posexplode("sums")).groupBy("kind", "pos").agg(F.sum("col").alias("v"))
    out = {0: np.zeros(3 + FEATURES * 2 + FEATURES**2), 1: np.zeros(3 + FEATURES * 2 + FEATURES**2)}
    for r in whole.collect():  # a fixed number of sums
        out[r.kind][r.pos] = r.v
    return out


def _newton(rows: DataFrame, prior: float, steps: int) -> np.ndarray:
    d = FEATURES
    ridge = RIDGE * np.eye(d)
    ridge[0, 0] = 0.0

    def risk(s, w):
        nu, np_ = max(s[0][0], 1), max(s[1][0], 1)
        negative = s[0][1] / nu - prior * s[1][1] / np_
        positive = prior * (s[1][1] - s[1][2]) / np_
        return negative, positive + max(negative, 0.0) + w @ ridge @ w / 2

    weights = np.zeros(d)
    sums = _sums(rows, weights)
    negative, now = risk(sums, weights)
    step, taken = None, 0
    for _ in range(steps):
        nu, np_ = max(sums[0][0], 1), max(sums[1][0], 1)
        slope = sums[0][3 + d : 3 + 2 * d] / nu - prior * sums[1][3 : 3 + d] / np_ + ridge @ weights
        curve = sums[0][3 + 2 * d :].reshape(d, d) / nu + ridge + 1e-9 * np.eye(d)
        step, size = np.linalg.solve(curve, slope), 1.0
        while True:
            tried = weights - size * step
            s = _sums(rows, tried)
            negative, after = risk(s, tried)
            if (after <= now and negative >= 0) or size < 0.05:
                break
            size /= 2
        if after > now or negative < 0:
            break
        done = now - after < 1e-5
        weights, sums, now = tried, s, after
        if done:
            break
    return weights


def fit(featured: DataFrame, labels: DataFrame, prior: float | None = None, steps: int = STEPS) -> Model:
    """Fit on all rows of ``feature_rows`` that are not held out.

    ``labels``: doc_id, quality.  Positives are rows labelled 1; the unlabelled set is every row.  ``prior``: the share of good
    documents; by default the share of label 1 among the labels of rows that are not held out (0.5 without any).
    Contradicting labels of one doc_id count as no label.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .filter(~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
        .filter("quality = _most")
        .select("doc_id", "quality")
    )
    if prior is None:
        share = known.agg(F.avg("quality")).first()[0]
        prior = 0.5 if share is None else min(max(share, 0.01), 0.99)
    training = featured.filter(~held_out())
    positives = training.join(known.filter("quality = 1"), "doc_id", "left_semi")
    rows = training.select(F.lit(0).alias("kind"), "x").unionByName(positives.select(F.lit(1).alias("kind"), "x"))
    rows = stored(rows, "quality-training")
    return Model(_newton(rows, prior, steps), prior)


def score(featured: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``feature_rows``."""
    w = model.weights.copy()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = _matrix(batch.column(1)) @ w
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(0.5 * (1 + np.tanh(f / 2)))], ["doc_id", "score"])

    scored = featured.select("doc_id", "x").mapInArrow(work, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def quality_scores(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> DataFrame:
    """Fit and score: doc_id, held_out, score, predicted; a row per row of ``docs`` (doc_id, text; others are ignored).

    Only texts enter a score.  Null counts as the empty text; empty texts are scored too (by the constant alone).  Rows without
    doc_id are scored, not held out and never positives.  Repeated rows get equal scores.  Without any positive the
    prior decides alone.  An empty table gives no rows.
    """
    featured = feature_rows(docs)
    return score(featured, fit(featured, labels, prior))


def keep_good(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is predicted to be good."""
    model = fit(feature_rows(docs), labels, prior)
    w = model.weights.copy()

    def good(texts: pa.Array) -> pa.Array:
        return pa.array([bool(features(t.as_py()) @ w >= 0) for t in texts], pa.bool_())

    return small_batches(docs).filter(F.arrow_udf(good, "boolean")(F.col("text").cast("string")))
