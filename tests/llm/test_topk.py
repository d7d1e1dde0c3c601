"""Top-k search against SQL and brute force."""

import numpy as np
import pytest
from compare import database, differences

from weftbook.llm import topk
from weftbook.llm.queries import ORACLE, QUERIES


def test_whole_table(spark, sf_dir):
    assert differences(QUERIES["op8_segment_search"](spark, sf_dir), database(sf_dir), ORACLE["op8_segment_search"]) == []


def brute(rows, every, k):
    vectors = sorted({(i, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v in rows})
    out = []
    for i, q in vectors:
        if i % every:
            continue
        scores = sorted({(-sum(a * b for a, b in zip(q, v)), j) for j, v in vectors if j != i and len(v) == len(q)})
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("group", [3, 8192])
def test_ties_repeats_and_odd_rows(spark, group):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=20).astype(np.float32)]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 320)] + [rows[7]] * 9 + [(400, [1.0]), (401, [0.5]), (450, [])]
    odd = [(500, None), (501, [None] * 20), (502, [float("nan")] * 20), (503, [float("inf")] + [0.0] * 19), (None, rows[0][1])]
    frame = spark.createDataFrame([(i, v, 3, i) for i, v in rows + odd], "vec_id long, embedding array<float>, label int, v long")
    vectors = topk.integer_vectors(frame)
    found = topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5, group)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 50, 5)


def test_queries_that_are_no_rows_of_the_table(spark):
    row = lambda first, value: [(first + i, [value + i, 1]) for i in range(12)]
    queries = spark.createDataFrame(row(1000, 5000), "vec_id long, v array<bigint>")
    vectors = spark.createDataFrame(row(0, 1), "vec_id long, v array<bigint>")
    found = sorted(tuple(r) for r in topk.top_k(vectors, queries, 3).collect())
    assert found == [(1000 + q, rank, 12 - rank, (5000 + q) * (13 - rank) + 1) for q in range(12) for rank in (1, 2, 3)]


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**20 + i), float(-(2**20) * (i % 3))]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k_every(frame).collect()) == brute(rows, 50, 5)


def test_empty_table(spark):
    assert topk.top_k_every(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_bounds_never_fall_below_the_score():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-99, 99, (50, 37)), rng.integers(-99, 99, (60, 37))
    limits = [topk._summary(a, s) @ topk._summary(b, s).T for s in topk.LEVELS]
    for limit in limits:
        assert (limit + 1e-6 >= a @ b.T).all()
    assert (limits[0] + 1e-6 >= limits[2]).mean() > 0.9  # finer levels are tighter
