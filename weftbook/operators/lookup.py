"""Joins that look a key up in a table where it is unique.

Every relation of the catalogue is of this kind: many rows on the left, at most one match on the right.  No size
is guessed here.  Spark broadcasts the right side if its own threshold allows, and after a shuffle again by the sizes
it has measured; else it sorts and merges, reading each side once.  One key, or rows without a key, may hold a large
part of the left rows: adaptive execution splits such a partition of the left side and gives every part the few right
rows it needs (``spark.sql.adaptive.skewJoin``, see session.SETTINGS).

``broadcast_bytes=0`` asks for the plan of a right side too large to broadcast, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _maybe_large(right: DataFrame, broadcast_bytes: int | None) -> DataFrame:
    return right.hint("merge") if broadcast_bytes == 0 else right


def lookup_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "left", broadcast_bytes: int | None = None
) -> DataFrame:
    """Join ``left`` with ``right``, whose ``on`` columns are unique.

    ``how`` is left, inner, left_semi or left_anti.
    """
    return left.join(_maybe_large(right, broadcast_bytes), on, how)


def lookup_few(few: DataFrame, right: DataFrame, on: list[str], broadcast_bytes: int | None = None) -> DataFrame:
    """Left join for a ``few`` that a limit already holds to some ten rows.

    A right side of any size is only filtered by their keys, never shuffled: it can match at most as many rows.
    """
    keys = F.broadcast(few.select(*on).distinct())
    matches = _maybe_large(right, broadcast_bytes).join(keys, on, "left_semi")
    return few.join(F.broadcast(matches), on, "left")


def unique_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "left", broadcast_bytes: int | None = None
) -> DataFrame:
    """Join where the key is unique on both sides, so that no key can be hot."""
    return left.join(_maybe_large(right, broadcast_bytes), on, how)


def present_keys(keys: DataFrame, table: DataFrame, key: str, broadcast_bytes: int | None = None) -> DataFrame:
    """Those of the unique ``keys`` that occur in a table; for few keys the table is only filtered."""
    return table.select(key).join(_maybe_large(keys.select(key), broadcast_bytes), key, "left_semi").distinct()


def child_counts(children: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Rows per non-null key; partial sums before the shuffle keep hot keys cheap."""
    return children.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))
