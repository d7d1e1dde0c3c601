"""Addresses of all public pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import link
from .feeds import published

# Fixed values: (path, how often it changes, priority) of the standing pages.
STANDING = (
    ("/", "daily", "1.0"),
    ("/news", "daily", "0.9"),
    ("/knowledge", "weekly", "0.8"),
    ("/jobs", "daily", "0.8"),
    ("/companies", "weekly", "0.7"),
    ("/services", "weekly", "0.6"),
    ("/tools", "monthly", "0.9"),
    ("/ai-studio", "monthly", "0.7"),
)
# Fixed values: (table, path section, only published rows, how often, priority).
LISTED = (
    ("news_articles", "news", True, "weekly", "0.8"),
    ("knowledge_articles", "knowledge", True, "monthly", "0.7"),
    ("jobs", "jobs", True, "weekly", "0.7"),
    ("companies", "companies", True, "weekly", "0.6"),
    ("tools", "tools", True, "monthly", "0.8"),
    ("news_categories", "news/category", False, "weekly", "0.7"),
    ("knowledge_categories", "knowledge/category", False, "weekly", "0.6"),
    ("tool_categories", "tools/category", False, "weekly", "0.7"),
)


def _standing(spark: SparkSession, base: str) -> DataFrame:
    rows = F.array(
        *[
            F.struct(F.lit(base.rstrip("/") + path).alias("loc"), F.lit(often).alias("changefreq"), F.lit(weight).alias("priority"))
            for path, often, weight in STANDING
        ]
    )
    return spark.range(1).select(F.inline(rows))


def sitemap(cat, base: str) -> DataFrame:
    """loc, changefreq and priority of every public page; nothing is shuffled."""
    parts = [_standing(cat.spark, base)]
    for table, section, only_published, often, weight in LISTED:
        items = getattr(cat, table)
        parts.append(
            (published(items) if only_published else items).select(
                link(base, section, F.col("slug")).alias("loc"),
                F.lit(often).alias("changefreq"),
                F.lit(weight).alias("priority"),
            )
        )
    return reduce(DataFrame.unionByName, parts)
