"""Exact top-k search by inner product, pruned with segment means and deviations from coarse to fine.

For a segment of L components the Cauchy-Schwarz inequality bounds the inner product by
L * (mean_q * mean_v + dev_q * dev_v); as |q - v|^2 = |q|^2 + |v|^2 - 2 qv, this is the known lower bound of the distance.  The
bound over one segment is tested first, then over 4 and 16; exact scores are computed for what survives.

Queries go out in groups of bounded size; every group is broadcast and each task of the vector table keeps the best k per
query that also beat a first threshold, taken from exact scores against some vectors of the group itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftbook.llm.common import stored

LEVELS = (1, 4, 16)
QUERY_GROUP = 8192
QUERY_CHUNK = 256
BLOCK_ROWS = 2048
SEEDS = 1024
DENSE_SHARE = 0.2
EXACT_FLOAT = 2.0**52

PARTIAL = "query_id long, vec_id long, score long"
PARTIAL_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and v, floor(256 * x) of every component; rows with a null id, vector or component, or a non-finite one,
    are left out."""
    x = F.col("embedding").cast("array<double>")
    whole = F.coalesce(
        F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False)
    )
    return (
        embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .filter(whole)
        .select(F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(c * 256)).alias("v"))
    )


def _matrices(ids: list[int], vectors: list[list[int]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of components: ids and vectors, every (id, vector) once."""
    by_size: dict[int, dict] = {}
    for i, v in zip(ids, vectors):
        row = np.array(v, np.int64)
        by_size.setdefault(len(row), {})[i, row.tobytes()] = row
    return {
        n: (np.array([k[0] for k in rows], np.int64), np.array(list(rows.values()), np.int64).reshape(len(rows), n))
        for n, rows in by_size.items()
    }


def _summary(matrix: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of all segments, weighted so that the product of two summaries is the bound."""
    count, size = matrix.shape
    borders = np.unique(np.linspace(0, size, segments + 1).astype(int)) if size else np.array([0])
    if len(borders) < 2:
        return np.zeros((count, 2))
    lengths = np.diff(borders)
    values = matrix.astype(np.float64)
    means = np.add.reduceat(values, borders[:-1], axis=1) / lengths
    squares = np.add.reduceat(values * values, borders[:-1], axis=1) / lengths
    deviations = np.sqrt(np.maximum(squares - means * means, 0))
    return np.hstack([means, deviations]) * np.sqrt(np.hstack([lengths, lengths]))


class Best:
    """The k best (score, vec_id) of a set of queries with vectors of one size."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int, least: np.ndarray | None = None):
        self.ids, self.matrix, self.k = ids, matrix, k
        self.levels = [_summary(matrix, s) for s in LEVELS]
        self.largest = int(np.abs(matrix).max(initial=0))
        self.least = np.full(len(ids), -np.inf) if least is None else least.astype(np.float64)
        self.found = np.empty((0, 3), np.int64)  # number of the query, vec_id, score

    def _exact(self, part: slice, matrix: np.ndarray) -> np.ndarray:
        bound = float(self.largest) * float(np.abs(matrix).max(initial=0)) * max(1, matrix.shape[1])
        if bound < EXACT_FLOAT:
            return (self.matrix[part].astype(np.float64) @ matrix.T.astype(np.float64)).astype(np.int64)
        return self.matrix[part] @ matrix.T

    def offer(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        summaries = [_summary(matrix, s) for s in LEVELS]
        more = len(ids) - len(np.unique(ids))
        offers = [self.found]
        for first in range(0, len(self.ids), QUERY_CHUNK):
            part = slice(first, first + QUERY_CHUNK)
            least = self.least[part]
            limit = self.levels[0][part] @ summaries[0].T
            slack = 1e-9 * (np.abs(limit) + 1)
            queries, rows = np.nonzero(limit + slack >= least[:, None])
            for mine, theirs in zip(self.levels[1:], summaries[1:]):
                if len(rows) > DENSE_SHARE * limit.size:
                    break
                limits = np.einsum("ij,ij->i", mine[part][queries], theirs[rows])
                keep = limits + 1e-9 * (np.abs(limits) + 1) >= least[queries]
                queries, rows = queries[keep], rows[keep]
            if len(rows) > DENSE_SHARE * limit.size:
                scores = self._exact(part, matrix)
                own = self.ids[part][:, None] == ids[None, :]
                if matrix.shape[0] > self.k + more + 1:
                    ranked = np.where(own, np.iinfo(np.int64).min, scores)
                    kth = np.partition(ranked, -(self.k + more), axis=1)[:, -(self.k + more)]
                    least = np.maximum(least, kth.astype(np.float64))
                queries, rows = np.nonzero((scores >= least[:, None]) & ~own)
                values = scores[queries, rows]
            else:
                values = np.einsum("ij,ij->i", self.matrix[part][queries], matrix[rows])
                keep = (values >= least[queries]) & (self.ids[part][queries] != ids[rows])
                queries, rows, values = queries[keep], rows[keep], values[keep]
            offers.append(np.column_stack([queries + first, ids[rows], values]))
        self._merge(np.concatenate(offers))

    def _merge(self, rows: np.ndarray) -> None:
        rows = rows[np.lexsort((rows[:, 1], -rows[:, 2], rows[:, 0]))]
        if len(rows) > 1:
            rows = rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])]
        starts = np.searchsorted(rows[:, 0], rows[:, 0])
        rank = np.arange(len(rows)) - starts
        self.found = rows[rank < self.k]
        full = rows[rank == self.k - 1]
        self.least[full[:, 0]] = np.maximum(self.least[full[:, 0]], full[:, 2])


def _first_thresholds(ids: np.ndarray, matrix: np.ndarray, k: int) -> np.ndarray:
    """Scores that k vectors are known to reach, from the first SEEDS vectors of the group."""
    best = Best(ids, matrix, k)
    best.offer(ids[:SEEDS], matrix[:SEEDS])
    return best.least


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, group: int = QUERY_GROUP, among: bool = False) -> DataFrame:
    """The k highest integer inner products of every query: query_id, rank, vec_id, score; ties to the smaller vec_id.

    Both inputs: vec_id, v (array<bigint>), as ``integer_vectors`` gives.  A query never meets rows of its own vec_id, and
    only vectors with as many components are scored.  Rows with equal vec_id and equal score count once; so repeated rows
    change nothing.  ``among`` says that every query is a row of ``vectors`` too, so that scores among the queries are first
    thresholds; without it none are taken for granted.  Fewer than k candidates give fewer rows; an empty table gives none.  Scores must fit 64 bits.
    """
    spark = vectors.sparkSession
    groups = max(1, -(-queries.count() // group))
    result = None
    for number in range(groups):
        members = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == number).select("vec_id", "v")
        rows = members.collect()  # about ``group`` rows
        sizes = _matrices([r.vec_id for r in rows], [r.v for r in rows])
        asked = spark.sparkContext.broadcast(
            {n: (ids, m, _first_thresholds(ids, m, k) if among else Best(ids, m, k).least) for n, (ids, m) in sizes.items()}
        )

        def work(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            best = {n: Best(ids, m, k, least.copy()) for n, (ids, m, least) in asked.value.items()}
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK_ROWS):
                    piece = batch.slice(at, BLOCK_ROWS)
                    for n, (ids, m) in _matrices(piece.column(0).to_pylist(), piece.column(1).to_pylist()).items():
                        if n in best:
                            best[n].offer(ids, m)
            for b in best.values():
                columns = [b.ids[b.found[:, 0]], b.found[:, 1], b.found[:, 2]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=PARTIAL_ARROW)

        part = vectors.select("vec_id", "v").mapInArrow(work, PARTIAL).distinct()
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        part = part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        part = part.select("query_id", "rank", "vec_id", "score")
        if groups > 1:
            part = stored(part, "top-k")
        result = part if result is None else result.unionByName(part)
    return result


def top_k_every(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """``top_k`` with the rows whose vec_id is divisible by ``every`` as queries, against all rows."""
    vectors = stored(integer_vectors(embeddings), "integer-vectors")
    return top_k(vectors, vectors.filter(F.col("vec_id") % every == 0), k, among=True)
