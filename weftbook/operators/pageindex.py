"""Index of a feed's pages: ranges of the sort order with their sizes.

Feeds are ordered newest first: rows without a moment, then by falling moment, equal moments by rising id.  The index cuts that
order at quantiles of the moment; a moment that would fill several ranges is cut further at quantiles of its ids.  The
range of a row is a function of its moment and id alone, so the index is only the borders and the number of rows between
them: it is built once and kept, and a page reads no more than the ranges that hold it.  The quantiles may be inexact: they decide how
even the ranges are, never which rows a page holds.

The rows must be the same at every reading (a stored table), ids unique whole numbers, moments dates or times without zone.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .feeds import newest_first
from .paging import PER_PAGE, page_number

RANGE_ROWS = 200_000  # rows aimed at in a range
MAX_RANGES = 1024  # more rows make the ranges larger; a page then cuts its own range again
ACCURACY = 20 * MAX_RANGES


class PageIndex:
    """``borders``: the first (moment, id) of every range but the first; ``sizes``: rows of every range."""

    def __init__(self, items: DataFrame, moment: str, borders: list[tuple], sizes: list[int], range_rows: int = RANGE_ROWS):
        self.items, self.moment, self.range_rows = items, moment, range_rows
        self.borders, self.sizes = borders, sizes
        self.ends = list(accumulate(sizes))

    @classmethod
    def build(cls, items: DataFrame, moment: str, range_rows: int = RANGE_ROWS) -> PageIndex:
        """Two or three passes over the moments and ids of ``items``."""
        borders = _borders(items, moment, range_rows)
        index = cls(items, moment, borders, [0] * (len(borders) + 1), range_rows)
        counted = items.groupBy(index.range_of().alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
        found = {row.part: row.n for row in counted}  # one number per range
        return cls(items, moment, borders, [found.get(k, 0) for k in range(len(borders) + 1)], range_rows)

    def save(self, path: str) -> None:
        """Store the borders and sizes; the rows stay where they are."""
        spark, first = self.items.sparkSession, (None, None)
        kinds = dict(self.items.dtypes)
        rows = [(k, *border, n) for k, (border, n) in enumerate(zip([first, *self.borders], self.sizes))]
        schema = f"part int, moment {kinds[self.moment]}, id {kinds['id']}, n bigint"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, items: DataFrame, moment: str, path: str, range_rows: int = RANGE_ROWS) -> PageIndex:
        """A saved index of the same ``items``."""
        rows = sorted(items.sparkSession.read.parquet(path).collect(), key=lambda r: r.part)
        return cls(items, moment, [(r.moment, r.id) for r in rows[1:]], [r.n for r in rows], range_rows)

    @property
    def total(self) -> int:
        return self.ends[-1]

    def _moment(self, value) -> str:
        return f"CAST('{value}' AS {dict(self.items.dtypes)[self.moment]})"

    def _behind(self, border: tuple) -> str:
        """SQL: whether a row stands at the border or behind it."""
        when, (moment, key) = f"`{self.moment}`", border
        if moment is None:
            return f"({when} IS NOT NULL OR id >= {key})"
        at = self._moment(moment)
        if key is None:
            return f"({when} IS NOT NULL AND {when} <= {at})"
        return f"({when} IS NOT NULL AND {when} <= {at} AND ({when} < {at} OR id >= {key}))"

    def range_of(self) -> Column:
        """The row's range, found by halving the borders.  It is built as text: a thousand nested columns are slow to make."""

        def choose(low: int, high: int) -> str:
            if low == high:
                return str(low)
            middle = (low + high) // 2
            return f"IF({self._behind(self.borders[middle])}, {choose(middle + 1, high)}, {choose(low, middle)})"

        return F.expr(choose(0, len(self.borders)))

    def between(self, first: int, last: int) -> DataFrame:
        """The rows of the ranges ``first`` to ``last``; bounds on the moment reach the files."""
        when, kept = f"`{self.moment}`", []
        after_dated = first > 0 and self.borders[first - 1][0] is not None
        if first > 0:
            kept.append(self._behind(self.borders[first - 1]))
        if last < len(self.borders):
            border = self.borders[last]
            if border[0] is None:
                kept.append(f"{when} IS NULL")
            else:
                least = f"{when} >= {self._moment(border[0])}"
                kept.append(least if after_dated else f"({when} IS NULL OR {least})")
            kept.append(f"NOT coalesce({self._behind(border)}, false)")
        return self.items.where(" AND ".join(kept)) if kept else self.items

    def page(self, number: str | int | None, per_page: int = PER_PAGE) -> DataFrame:
        """One page in order; a page past the end is empty."""
        skip = (page_number(number) - 1) * per_page
        return self.slice(skip, per_page)

    def slice(self, skip: int, n: int) -> DataFrame:
        """``n`` rows behind the first ``skip``.  Ranges much larger than aimed at are cut again first."""
        if skip >= self.total:
            return self.items.limit(0)
        first = bisect_right(self.ends, skip)
        last = min(bisect_right(self.ends, skip + n - 1), len(self.borders))
        rows, before = self.between(first, last), self.ends[first] - self.sizes[first]
        held = self.ends[last] - before
        if held < self.total and held > 4 * self.range_rows + n:
            return PageIndex.build(rows, self.moment, self.range_rows).slice(skip - before, n)
        return rows.orderBy(*newest_first(self.moment)).offset(skip - before).limit(n)

    def all_pages(self, per_page: int = PER_PAGE) -> DataFrame:
        """All rows with ``position`` (from 1) and ``page_no``: one shuffle by range, each range numbered by itself."""
        place = Window.partitionBy("__part").orderBy(*newest_first(self.moment))
        starts = F.expr(f"array({', '.join(f'{end - n}L' for end, n in zip(self.ends, self.sizes))})")
        return (
            self.items.withColumn("__part", self.range_of())
            .withColumn("position", F.element_at(starts, F.col("__part") + 1) + F.row_number().over(place))
            .withColumn("page_no", F.floor((F.col("position") - 1) / per_page) + 1)
            .drop("__part")
        )

    def page_count(self, per_page: int = PER_PAGE) -> int:
        return -(-self.total // per_page)


def _quantiles(column: Column, parts: int) -> Column:
    return F.percentile_approx(column, [k / parts for k in range(1, parts)], ACCURACY)


def _borders(items: DataFrame, moment: str, range_rows: int) -> list[tuple]:
    """Distinct borders in feed order, at most about MAX_RANGES."""
    when = F.col(moment)
    size = items.agg(F.count(F.lit(1)).alias("n"), F.count(when).alias("dated")).first()
    parts = min(-(-size.n // range_rows), MAX_RANGES)
    if parts < 2:
        return []
    aim = size.n / parts
    dated = items.agg(_quantiles(when, parts).alias("at")).first().at or [] if size.dated else []
    # The quantiles count dated rows only, so a range of theirs is no larger than aimed at.
    full = {m for m in dated if dated.count(m) > 1}
    undated = size.n - size.dated
    cuts: dict = {m: [] for m in full}
    if undated > aim:
        cuts[None] = []
    if cuts:
        asked = when.isin(list(full)) if full else F.lit(False)
        if None in cuts:
            asked = asked | when.isNull()
        for row in items.where(asked).groupBy(when.alias("m")).agg(F.count(F.lit(1)).alias("n"), _quantiles(F.col("id"), parts).alias("at")).collect():
            wanted = min(int(row.n // aim), parts - 1)
            cuts[row.m] = sorted({row.at[(k + 1) * len(row.at) // (wanted + 1)] for k in range(wanted)} - {None})
    borders = [(None, key) for key in cuts.pop(None, [])]
    for m in sorted(set(dated), reverse=True):
        borders.append((m, None))  # all ids of the moment
        borders += [(m, key) for key in cuts.get(m, [])]
    return borders
