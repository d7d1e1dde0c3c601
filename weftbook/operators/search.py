"""Keyword search over the five kinds of items."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DASH_DATE, date_text, shown, word_cut
from .feeds import first_n
from .lookup import lookup_few

# Fixed value: hits shown per section.
HITS = 10

# The columns each kind is searched in.
SEARCHED = {
    "news": ("title", "summary", "content"),
    "knowledge": ("title", "summary", "content"),
    "jobs": ("title", "description", "location"),
    "companies": ("name", "description", "address"),
    "tools": ("name", "description"),
}
TABLE_OF = {
    "news": "news_articles",
    "knowledge": "knowledge_articles",
    "jobs": "jobs",
    "companies": "companies",
    "tools": "tools",
}


def contains_text(field: Column, query: str) -> Column:
    """Case does not matter; ``%`` and ``_`` in the query are wildcards.

    A backslash takes the special meaning off a following ``%``, ``_`` or backslash; before
    any other character Spark needs it doubled.
    """
    pattern = re.sub(r"\\([%_\\])|\\", lambda m: m.group(0) if m.group(1) else r"\\", query)
    return field.ilike(f"%{pattern}%")


def matches(items: DataFrame, fields: tuple[str, ...], query: str) -> DataFrame:
    """All items with the query in any of the fields; a NULL field is no match."""
    return items.where(reduce(lambda a, b: a | b, [F.coalesce(contains_text(F.col(f), query), F.lit(False)) for f in fields]))


def keyword_search(kind: str, items: DataFrame, query: str, hits: int = HITS) -> DataFrame:
    """The first ``hits`` published matches by id; a blank query gives none."""
    query = query.strip()
    found = matches(items, SEARCHED[kind], query) if query else items.where(F.lit(False))
    return first_n(found, hits)


def search_results(kind: str, cat, query: str, hits: int = HITS) -> DataFrame:
    """Hits as shown: title, text and a note on date, category, company or address."""
    return as_results(kind, cat, keyword_search(kind, getattr(cat, TABLE_OF[kind]), query, hits))


def as_results(kind: str, cat, found: DataFrame) -> DataFrame:
    """The items ``found`` in the columns of ``search_results``."""
    title, none = ("name" if kind in ("companies", "tools") else "title"), F.lit(None).cast("string")
    text = F.col("summary")
    if kind == "news":
        note = F.concat(F.lit("Published on "), date_text(F.col("published_at"), DASH_DATE))
    elif kind == "knowledge":
        names = cat.knowledge_categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
        found = lookup_few(found, names, ["category_id"])
        note = F.concat(F.lit("Category: "), F.coalesce("category", F.lit("General")))
    elif kind == "jobs":
        names = cat.companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"))
        found = lookup_few(found, names, ["company_id"])
        text = word_cut(F.col("description"))
        note = F.concat(F.lit("Company: "), "company", F.lit(" | Location: "), "location")
    elif kind == "companies":
        text = word_cut(F.col("description"))
        note = F.concat(F.lit("Address: "), shown("address"))
    else:
        text, note = F.col("description"), none
    return found.select(
        F.lit(kind).alias("section"), "id", F.col(title).alias("title"), "slug", text.alias("text"), note.alias("note")
    )


def search_all(cat, query: str, hits: int = HITS) -> DataFrame:
    """The five searches in one frame: independent branches of one job."""
    return reduce(DataFrame.unionByName, [search_results(kind, cat, query, hits) for kind in SEARCHED])


def search_totals(cat, query: str, hits: int = HITS) -> DataFrame:
    """Hits per section and, under 'all', in total; both after the cap of ``hits``."""
    sections = [
        keyword_search(kind, getattr(cat, TABLE_OF[kind]), query, hits)
        .agg(F.count(F.lit(1)).alias("hits"))
        .select(F.lit(kind).alias("section"), "hits")
        for kind in SEARCHED
    ]
    each = reduce(DataFrame.unionByName, sections)
    return each.rollup("section").agg(F.sum("hits").alias("hits")).select(
        F.coalesce("section", F.lit("all")).alias("section"), "hits"
    )
