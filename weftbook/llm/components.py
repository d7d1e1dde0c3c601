"""Connected components of links between documents, as joins and minima on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftbook.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from every node that has a link: columns node, component.

    ``links``: columns a and b (long), in any direction, repeated or not.  Alternates two steps until nothing changes: every
    node hands its larger neighbours, then its smaller ones, to the smallest node it knows.  An edge table of at most
    the number of links is all there is, and a node with many links is only ever reduced to a minimum.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        outer = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = outer.groupBy("a").agg(F.min("b").alias("m"))
        inner = outer.join(least, "a")
        inner = inner.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(inner.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
