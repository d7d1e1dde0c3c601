"""Tables stored in blocks of ids, changed in place, with counts that are kept up.

Below the table's folder lie ``rows/block=<b>`` (b: the id without its last ``bits`` bits) and ``counts/batch=<n>``.  A batch of
creates, edits and deletes reads and rewrites only the blocks that hold one of its ids (dynamic partition overwrite), and adds
a few signed counts per status and category.  The site's ids rise with time, so new rows share the newest blocks.

A deleted row leaves its id behind with ``gone`` set.  So no block ever runs empty, an id is never given twice, and a batch
can run again after a crash at any moment: its counts are taken before any row changes and are not taken again once they
are complete; its rows come out the same however many of its blocks were already rewritten.  Batches are applied one at a time,
by rising number; a batch must be run again until it is through before the next one starts.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import changes as apply
from ..operators.lookup import present_keys, unique_join

BITS = 18  # at most 262,144 rows in a block
COUNTED = {"status": "string", "category_id": "bigint"}
COUNT_ROWS = "status string, category_id bigint, n bigint, bits int, form string"


def _block(bits: int) -> Column:
    return F.shiftright(F.col("id").cast("bigint"), bits).alias("block")


def _write_rows(df: DataFrame, root: str, bits: int) -> None:
    """Replace the blocks that ``df`` holds rows of.  Sorted ranges of block and id: a block is a few files, not one per task."""
    rows = df.withColumn("block", _block(bits)).repartitionByRange("block", "id").sortWithinPartitions("block", "id")
    rows.write.partitionBy("block").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{root}/rows")


def _read_counts(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(COUNT_ROWS + ", batch int").parquet(f"{root}/counts")


def _form(spark: SparkSession, root: str) -> tuple[int, StructType]:
    """Bits of a block and columns of the table, as ``write_blocks`` stored them."""
    first = _read_counts(spark, root).where("batch = 0 AND bits IS NOT NULL").first()
    return first.bits, StructType.fromJson(json.loads(first.form))


def _stored_rows(spark: SparkSession, root: str) -> DataFrame:
    form = _form(spark, root)[1]
    return spark.read.schema(StructType([*form.fields, StructField("block", LongType())])).parquet(f"{root}/rows")


def _counts(df: DataFrame, sign: int) -> DataFrame:
    """Rows per status and category (those of the two that the table has), with a sign."""
    kept = [(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in COUNTED.items()]
    return df.select(*kept).groupBy(*COUNTED).agg((F.count(F.lit(1)) * sign).alias("n"))


def _write_counts(counts: DataFrame, root: str, batch: int, bits: int | None = None, form: str | None = None) -> None:
    """Store a batch's counts and a mark in one file, which is there as a whole or not at all."""
    mark = counts.sparkSession.createDataFrame([(None, None, 0, bits, form)], COUNT_ROWS)
    rows = counts.withColumns({"bits": F.lit(None).cast("int"), "form": F.lit(None).cast("string")}).unionByName(mark)
    rows.coalesce(1).write.mode("overwrite").parquet(f"{root}/counts/batch={batch}")


def write_blocks(df: DataFrame, root: str, bits: int = BITS) -> None:
    """Store a table for the first time.  ``id`` must be a unique whole number."""
    rows = df.withColumn("gone", F.lit(False))
    _write_rows(rows, root, bits)
    stored = df.sparkSession.read.schema(df.schema).parquet(f"{root}/rows")
    _write_counts(_counts(stored, 1), root, 0, bits, rows.schema.json())


def read_blocks(spark: SparkSession, root: str) -> DataFrame:
    """The rows that are not deleted."""
    return _stored_rows(spark, root).where(~F.col("gone")).drop("gone", "block")


def touched_blocks(changes: DataFrame, bits: int) -> list[int]:
    """Blocks that hold an id of the batch: no more numbers than the table has folders."""
    return sorted(row.block for row in changes.where(F.col("id").isNotNull()).select(_block(bits)).distinct().collect())


def first_creates(creates: DataFrame) -> DataFrame:
    """One create per id: the earliest, of equal moments the one with the smaller values."""
    rest = [c for c in creates.columns if c not in ("id", "changed_at")]
    first = creates.groupBy("id").agg(F.min(F.struct("changed_at", *rest)).alias("__row"))
    return first.select("id", "__row.*")


def changed_rows(stored: DataFrame, changes: DataFrame, fields: Sequence[str], default_status: str, title: str) -> DataFrame:
    """The stored rows, tombstones included, after a batch.

    A create of an id that is or was given changes nothing.  Edits and deletes of ids without a row change nothing.
    """
    live, gone = stored.where(~F.col("gone")).drop("gone"), stored.where(F.col("gone"))
    of = {op: changes.where((F.col("op") == op) & F.col("id").isNotNull()) for op in ("create", "edit", "delete")}
    creates = first_creates(of["create"])
    creates = unique_join(creates, present_keys(creates.select("id"), stored, "id"), ["id"], "left_anti")
    grown = apply.apply_edits(apply.apply_creates(live, creates, default_status, title), of["edit"], list(fields), default_status, title)
    asked = of["delete"].select("id").distinct().withColumn("gone", F.lit(True))
    left = unique_join(grown, asked, ["id"]).withColumn("gone", F.coalesce("gone", F.lit(False)))
    emptied = [F.col(c) if c in ("id", "gone") else F.when(~F.col("gone"), F.col(c)).alias(c) for c in stored.columns]
    return left.select(*emptied).unionByName(gone)


def apply_batch(
    spark: SparkSession,
    root: str,
    batch: int,
    changes: DataFrame,
    fields: Sequence[str],
    default_status: str = apply.ARTICLE_DEFAULT,
    title: str = "title",
) -> list[int]:
    """Apply change rows (``op``: create, edit or delete) to the stored table; gives the blocks that were rewritten.

    ``batch`` counts from 1.  Running the last batch again changes nothing; an earlier one is refused.  ``changes`` must be
    the same rows at every reading.
    """
    last = _read_counts(spark, root).agg(F.max("batch")).first()[0]
    if batch < max(last, 1):
        raise ValueError(f"batch {batch} comes after batch {last}")
    bits = _form(spark, root)[0]
    blocks = touched_blocks(changes, bits)
    if not blocks:
        return []
    stored = _stored_rows(spark, root).where(F.col("block").isin(blocks)).drop("block")
    if batch > last:
        ids = changes.select("id").where(F.col("id").isNotNull()).distinct()
        before = unique_join(stored, ids, ["id"], "left_semi").select(*stored.columns)
        after = changed_rows(before, changes, fields, default_status, title)
        parts = [_counts(rows.where(~F.col("gone")), sign) for rows, sign in ((before, -1), (after, 1))]
        delta = reduce(DataFrame.unionByName, parts).groupBy(*COUNTED).agg(F.sum("n").alias("n")).where("n <> 0")
        _write_counts(delta, root, batch)
    _write_rows(changed_rows(stored, changes, fields, default_status, title), root, bits)
    return blocks


def stored_counts(spark: SparkSession, root: str) -> DataFrame:
    """Rows per status and category by the kept counts: reads a few rows per batch, never the table."""
    return _read_counts(spark, root).groupBy(*COUNTED).agg(F.sum("n").alias("n")).where("n <> 0")
