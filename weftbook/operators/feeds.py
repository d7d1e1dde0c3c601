"""Published feeds: filters, relation columns, orders and projections.

Where the pages leave an order open, ``id`` decides, so results do not depend on how
data is split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import iso_text
from ..schemas import PUBLISHED
from .lookup import lookup_join


def published(items: DataFrame) -> DataFrame:
    return items.where(F.col("status") == PUBLISHED)


def newest_first(moment: str) -> list[Column]:
    """Latest first; rows without a date come before all others.  ``id`` splits ties, so
    that a sort over many tasks stays even where one date holds most rows."""
    return [F.desc_nulls_first(moment), F.col("id")]


def with_category(items: DataFrame, categories: DataFrame, **options) -> DataFrame:
    """Add ``category``, the name of the item's category, or NULL."""
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return lookup_join(items, names, ["category_id"], **options)


def with_author(items: DataFrame, users: DataFrame, fallback: str | None = None, **options) -> DataFrame:
    """Add ``author``, the name of the writer, or ``fallback`` where there is none."""
    names = users.select(F.col("id").alias("author_id"), F.col("username").alias("author"))
    found = lookup_join(items, names, ["author_id"], **options)
    return found if fallback is None else found.withColumn("author", F.coalesce("author", F.lit(fallback)))


def jobs_with_company(jobs: DataFrame, companies: DataFrame, **options) -> DataFrame:
    """Add ``company`` and ``company_slug``; one company may own very many jobs."""
    names = companies.select(
        F.col("id").alias("company_id"), F.col("name").alias("company"), F.col("slug").alias("company_slug")
    )
    return lookup_join(jobs, names, ["company_id"], **options)


def services_with_provider(services: DataFrame, companies: DataFrame, **options) -> DataFrame:
    names = companies.select(
        F.col("id").alias("provider_id"), F.col("name").alias("provider"), F.col("slug").alias("provider_slug")
    )
    return lookup_join(services, names, ["provider_id"], **options)


def article_feed(articles: DataFrame, categories: DataFrame) -> DataFrame:
    """News or guides, newest first."""
    return (
        with_category(published(articles), categories)
        .orderBy(*newest_first("published_at"))
        .select(
            "id",
            "title",
            "slug",
            "summary",
            "content",
            "featured_image",
            iso_text(F.col("published_at")).alias("published_at"),
            "category",
            "seo_title",
            "seo_description",
        )
    )


def job_feed(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    return (
        jobs_with_company(published(jobs), companies)
        .orderBy(*newest_first("created_at"))
        .select(
            "id",
            "title",
            "slug",
            "description",
            "location",
            "salary_range",
            "job_type",
            "company",
            iso_text(F.col("created_at")).alias("created_at"),
        )
    )


def company_feed(companies: DataFrame, categories: DataFrame) -> DataFrame:
    return (
        with_category(published(companies), categories)
        .select("id", "name", "slug", "description", "logo", "category", "website", "email", "phone", "address")
    )


def service_feed(services: DataFrame, companies: DataFrame) -> DataFrame:
    return (
        services_with_provider(published(services), companies)
        .select("id", "name", "slug", "description", "provider")
    )


def tool_feed(tools: DataFrame, categories: DataFrame) -> DataFrame:
    return (
        with_category(published(tools), categories)
        .select("id", "name", "slug", "description", "category")
    )


def in_category(items: DataFrame, categories: DataFrame, slug: str) -> DataFrame:
    """Published items of the category with this slug; an unknown slug gives no rows.

    The category is one row, so the items are filtered where they lie.
    """
    wanted = categories.where(F.col("slug") == slug).select(
        F.col("id").alias("category_id"), F.col("name").alias("category")
    )
    return lookup_join(published(items), wanted, ["category_id"], "inner")


def find_by_slug(requests: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Requested slugs with the id of the published item, and whether there is one.

    ``requests`` has a ``slug`` column; a slug asked for very often does not hurt.
    """
    hits = published(items).select("slug", "id")
    return lookup_join(requests, hits, ["slug"], **options).withColumn("found", F.col("id").isNotNull())


def records_by_slug(requests: DataFrame, feed: DataFrame, **options) -> DataFrame:
    """The feed's whole record for every requested slug, and whether there is one."""
    hits = feed.withColumn("found", F.lit(True))
    return lookup_join(requests.select("slug"), hits, ["slug"], **options).withColumn("found", F.col("found").isNotNull())


def first_n(items: DataFrame, n: int, order: list[Column] | None = None) -> DataFrame:
    """The first ``n`` published items by ``order`` (``id`` if none): a top-k, not a sort."""
    return published(items).orderBy(*(order or [F.col("id")])).limit(n)
