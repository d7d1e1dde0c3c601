"""Pages of ten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from .feeds import published

PER_PAGE = 10  # fixed value: rows of a page
DEEP_ROWS = 10_000


def page_number(text: str | int | None) -> int:
    """The page asked for; anything that is not a whole number above zero means the first."""
    try:
        return max(int(text), 1)
    except (TypeError, ValueError):
        return 1


def page_of(
    items: DataFrame,
    order: list[Column],
    page: str | int | None = 1,
    per_page: int = PER_PAGE,
    deep: int = DEEP_ROWS,
) -> DataFrame:
    """One page; a page past the end is empty.

    A page near the front is a top-k, which brings all rows up to the page into one task.
    Behind ``deep`` rows the pages are numbered side by side instead.
    """
    number = page_number(page)
    skip = (number - 1) * per_page
    if skip + per_page > deep:
        page = all_pages(items, order, per_page).where(F.col("page_no") == number)
        return page.orderBy("position").select(*items.columns)
    return items.orderBy(*order).offset(skip).limit(per_page)


def place_on_page(order: list[Column]) -> Column:
    """Place of a row among the few rows of one page, from 1."""
    return F.row_number().over(Window.orderBy(*order)).cast("bigint")


def page_counts(feeds: dict[str, DataFrame], per_page: int = PER_PAGE) -> DataFrame:
    """Published rows and pages of every feed; an empty feed has no pages."""
    parts = [
        published(items).agg(F.count(F.lit(1)).alias("total")).select(F.lit(name).alias("feed"), "total")
        for name, items in feeds.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("pages", F.ceil(F.col("total") / per_page))


def all_pages(items: DataFrame, order: list[Column], per_page: int = PER_PAGE) -> DataFrame:
    """Number all rows in ``order``: adds ``position`` (from 1) and ``page_no``.

    A plain row number over everything would put all rows in one task.  Here the rows are
    split by ranges of the sort key, each range numbers its own rows, and the sizes of
    the earlier ranges are added.  ``order`` must end in a unique column, so that no
    value can fill a range by itself.  The split is stored (a checkpoint in the shared
    folder) because the sizes and the rows have to come from the same split.
    """
    spark = items.sparkSession
    shared_folder(spark)
    serial = F.col("__serial")
    split = (
        items.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__serial", F.monotonically_increasing_id())
        # The upper bits of the serial are the partition, the lower 33 its row.
        .withColumn("__part", F.shiftright(serial, 33))
        .withColumn("__row", serial - F.shiftleft(F.shiftright(serial, 33), 33) + 1)
        .drop("__serial")
        .checkpoint()
    )
    # One row per partition of the split, so this window and broadcast stay small.
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        split.groupBy("__part")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    )
    return (
        split.join(F.broadcast(starts), "__part")
        .withColumn("position", F.col("__start") + F.col("__row"))
        .withColumn("page_no", F.floor((F.col("position") - 1) / per_page) + 1)
        .drop("__part", "__row", "__start")
    )
