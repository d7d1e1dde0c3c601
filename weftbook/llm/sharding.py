"""Shards of near equal bytes by Karmarkar-Karp differencing over indivisible groups of equal texts.

Group sizes are summed in Spark.  Groups with more than 1/CRATES of all bytes (fewer than CRATES of them) are items of
their own; the others are dealt by hash into CRATES crates, whose sums are the further items.  So at most 2 * CRATES
numbers reach the driver, whatever the input; there the two partial partitions with the largest spread are
combined again and again, the larger piles of one with the smaller of the other.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftbook.llm.common import stored, text_or_empty

CRATES = 4096
PARTITION_SHIFT = 33  # monotonically_increasing_id holds the partition above this bit


def differencing(sizes: list[int], parts: int) -> list[int]:
    """The part of every item, by repeated combination of the two partial partitions with the largest spread."""
    # A partial partition: piles from large to small, each (sum, tree of items).
    heap = []
    for i, size in enumerate(sizes):
        piles = [(size, i)] + [(0, None)] * (parts - 1)
        heap.append((-size if parts > 1 else 0, i, piles))
    heapq.heapify(heap)
    number = len(sizes)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        joined = [
            (x[0] + y[0], (x[1], y[1]) if x[1] is not None and y[1] is not None else x[1] if y[1] is None else y[1])
            for x, y in zip(a, reversed(b))
        ]
        joined.sort(key=lambda pile: -pile[0])
        heapq.heappush(heap, (joined[-1][0] - joined[0][0], number, joined))
        number += 1
    place = [0] * len(sizes)
    for part, (_, tree) in enumerate(heap[0][2] if heap else []):
        stack = [] if tree is None else [tree]
        while stack:
            top = stack.pop()
            if isinstance(top, tuple):
                stack += top
            else:
                place[top] = part
    return place


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Every row's shard under the law ``bytes``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the UTF-8 bytes of the text plus 1.  Rows with equal texts (null counts as empty) share a shard; the sums
    of sizes are as near to each other as the largest group allows.  Slots count from 0 within a shard, gapless.
    Uses doc_id and text only; repeated rows and null ids are rows like any other; an empty table gives no rows.
    """
    spark = docs.sparkSession
    raw = text_or_empty().cast("binary")
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long"),
            (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.unhex(F.sha2(raw, 256)).alias("_text"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "shard-rows",
    )
    crate = F.pmod(F.xxhash64("_text"), F.lit(CRATES)).cast("int")
    groups = stored(rows.groupBy("_text").agg(F.sum("size").alias("bytes")).withColumn("_crate", crate), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    heavy = groups.filter(F.col("bytes") * CRATES > total).select("_text", "bytes")
    crates = groups.filter(F.col("bytes") * CRATES <= total).groupBy("_crate").agg(F.sum("bytes").alias("bytes"))
    large = heavy.orderBy(F.desc("bytes"), "_text").collect()  # fewer than CRATES rows
    small = crates.orderBy("_crate").collect()  # at most CRATES rows
    place = differencing([r.bytes for r in large] + [r.bytes for r in small], shards)
    of_large = spark.createDataFrame(
        [(r._text, p) for r, p in zip(large, place)], "_text binary, _own int"
    )
    of_crate = spark.createDataFrame(
        [(r._crate, p) for r, p in zip(small, place[len(large) :])], "_crate int, _shared int"
    )
    placed = (
        rows.withColumn("_crate", crate)
        .join(F.broadcast(of_large), "_text", "left")
        .join(F.broadcast(of_crate), "_crate", "left")
        .select(
            "doc_id", "size", "text_crc32", F.coalesce("_own", "_shared").alias("shard"), "_row",
            F.shiftright("_row", PARTITION_SHIFT).alias("_part"),
        )
    )
    # Slots: rows of one stored partition and shard are numbered together, behind those of earlier partitions.
    counts = placed.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_row"))
    return (
        placed.withColumn("_inside", inside)
        .join(offsets, ["shard", "_part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("_first") + F.col("_inside") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
