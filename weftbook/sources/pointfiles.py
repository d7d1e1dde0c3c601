"""Tables for point look-ups: sorted by one key, with bloom filters on several, read by pushed equality.

A look-up of few values opens a file's row group only if its statistics and its bloom filter admit one of them.  The table is
sorted by the first key, so for that one the statistics do most of the work; the others rest on the filters.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROW_GROUP = 16 << 20  # bytes
VALUES_PER_GROUP = 100_000  # distinct values a filter is sized for; more raise its rate of false hits, never lose a row
ASKED_AT_ONCE = 64


def write_points(df: DataFrame, path: str, keys: Sequence[str], row_group: int = ROW_GROUP, values: int = VALUES_PER_GROUP) -> None:
    """Store a table sorted by ``keys[0]``, then the others, with a bloom filter on each key (texts or whole numbers).

    Ranges are cut by all keys, so one value of the first that holds a large part of the rows is split.
    """
    writer = df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").option("parquet.block.size", row_group)
    for key in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", values)
    writer.parquet(path)


def any_of(column: str, values: Sequence) -> Column:
    """Equality with one of the values as a tree of ORs: Spark pushes a long IN as a range only, which no filter can use."""
    tests = [F.col(column) == value for value in values]
    while len(tests) > 1:
        tests = [reduce(lambda a, b: a | b, tests[at:at + 2]) for at in range(0, len(tests), 2)]
    return tests[0] if tests else F.lit(False)


def find_points(spark: SparkSession, path: str, schema: StructType, column: str, values: Sequence) -> DataFrame:
    """All rows that hold one of the values.  NULL among them finds nothing; values asked twice count once; none give no row.

    Values are asked in groups of ASKED_AT_ONCE, each a scan of its own over the row groups it needs.  Thousands of values should
    be joined instead (``feeds.find_by_slug``).
    """
    asked = sorted({value for value in values if value is not None})
    table = spark.read.schema(schema).parquet(path)
    groups = [asked[at:at + ASKED_AT_ONCE] for at in range(0, len(asked), ASKED_AT_ONCE)] or [[]]
    return reduce(DataFrame.unionByName, [table.where(any_of(column, group)) for group in groups])
