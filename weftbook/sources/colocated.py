"""Tables stored in buckets of the owner's key, so that owners and their rows meet without a shuffle.

``write_colocated`` puts a table's rows into sorted buckets of one column.  Rows whose key is *hot* (it holds more than a bucket's
even share, so there are fewer such keys than buckets) or NULL would make one bucket long: they are stored beside the buckets,
spread evenly.  ``by_owner`` builds a result from both parts: the buckets of all tables side by side for the other owners,
and an ordinary look-up of the few hot owners, small enough to broadcast, for the rest.

Below the folder lie ``buckets``, ``spread`` and ``form`` (number of buckets, columns and hot keys); a session that did not write
them opens them from there.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORM = "buckets int, key_column string, columns string, hot bigint"


def _table(path: str) -> str:
    """The name of a folder's buckets in the session's catalogue."""
    return "weftbook_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def write_colocated(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Store a table in ``buckets`` buckets of ``key``, a whole number.  Tables to be joined take the same number.

    ``df`` must be the same rows at every reading.  An empty table, and one whose keys are all NULL, have empty buckets.
    """
    spark, keys = df.sparkSession, F.col(key)
    counts = df.where(keys.isNotNull()).groupBy(keys.cast("bigint").alias("hot")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = [row.hot for row in counts.where((F.col("n") * buckets > total) & (F.col("n") > 1)).collect()]  # fewer than buckets
    aside = keys.isNull() | keys.cast("bigint").isin(hot)
    df.where(aside).write.mode("overwrite").parquet(f"{path}/spread")
    (
        df.where(~aside).withColumn(key, keys.cast("bigint")).repartition(buckets, key).write.mode("overwrite").format("parquet")
        .bucketBy(buckets, key).sortBy(key).option("path", f"{path}/buckets").saveAsTable(_table(path))
    )
    columns = spark.table(_table(path)).schema.json()
    rows = [(buckets, key, columns, value) for value in [None, *sorted(hot)]]
    spark.createDataFrame(rows, FORM).coalesce(1).write.mode("overwrite").parquet(f"{path}/form")


class Colocated:
    """A stored table: ``even`` (its buckets), ``spread`` (rows of hot and missing keys), ``rows`` (all) and ``hot`` (keys)."""

    def __init__(self, spark: SparkSession, path: str):
        form = spark.read.schema(FORM).parquet(f"{path}/form").collect()
        self.key, self.buckets = form[0].key_column, form[0].buckets
        self.hot = sorted(row.hot for row in form if row.hot is not None)
        columns = StructType.fromJson(json.loads(form[0].columns))
        if not spark.catalog.tableExists(_table(path)):
            named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
            place = f"{path}/buckets".replace("'", "\\'")
            spark.sql(
                f"CREATE TABLE {_table(path)} ({named}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) "
                f"INTO {self.buckets} BUCKETS LOCATION '{place}'"
            )
        self.even = spark.table(_table(path))
        self.spread = spark.read.schema(columns).parquet(f"{path}/spread")
        self.rows = self.even.unionByName(self.spread)

    def _of(self, keys: list[int]) -> Column:
        return F.col(self.key).isin(keys)

    def among(self, keys: list[int]) -> DataFrame:
        """All rows of some keys."""
        return self.rows.where(self._of(keys))

    def except_for(self, keys: list[int]) -> DataFrame:
        """The buckets' rows of all other keys."""
        return self.even.where(~self._of(keys)) if keys else self.even


def by_owner(build: Callable[..., DataFrame], owners: Colocated, *children: Colocated) -> DataFrame:
    """``build(owners, *children)`` for a result in which every row belongs to one owner.

    Children without an owner's key take no part: ``without_key`` gives them.  At most as many owners as there are buckets, per
    table of children, are hot; what is built for them is a small table of owners against rows that no shuffle moves.
    """
    tables = (owners, *children)
    if len({t.buckets for t in tables}) > 1:
        raise ValueError("tables differ in their number of buckets")
    hot = sorted({key for t in tables for key in t.hot})
    even = build(*[t.except_for(hot) for t in tables])
    if not hot:
        return even
    return even.unionByName(build(F.broadcast(owners.among(hot)), *[t.among(hot) for t in children]))


def without_key(children: Colocated) -> DataFrame:
    """Rows that have no owner."""
    return children.spread.where(F.col(children.key).isNull())
