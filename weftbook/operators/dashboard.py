"""Front page blocks and the editors' overview."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.images import size_label
from ..functions.text import DASH_DATE, DASH_TIME, LONG_DATE, SHORT_DATE, date_text, either, shown
from .feeds import first_n, jobs_with_company, newest_first, with_category
from .lookup import lookup_few
from .pages import HOME_TAGS, NO_SALARY, _card

# Kinds counted on the overview, block sizes of the front page.
COUNTED = {
    "news": "news_articles",
    "knowledge": "knowledge_articles",
    "jobs": "jobs",
    "companies": "companies",
    "tools": "tools",
}
# Rows of each block, and texts for what is missing.
LATEST, FEATURED, INBOX = 3, 4, 5
NO_CATEGORY, NO_DATE = "None", "Not Published"


def dashboard_counts(cat) -> DataFrame:
    """Rows of each kind in every status.  An empty kind shows 0."""
    return reduce(
        DataFrame.unionByName,
        [
            getattr(cat, table).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
            for kind, table in COUNTED.items()
        ],
    )


def _ranked(few: DataFrame, order: list[Column]) -> DataFrame:
    """Rank the few rows of one block; the block is a top-k, so one task is enough."""
    return few.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _names(parents: DataFrame, key: str, name: str) -> DataFrame:
    return parents.select(F.col("id").alias(key), F.col("name").alias(name))


def homepage(cat) -> DataFrame:
    """The five blocks of the front page as ranked cards.

    Each block is cut to its few rows first; only those look up a category or company.
    """
    by_id = [F.col("id")]
    latest, recent = newest_first("published_at"), newest_first("created_at")
    news = lookup_few(
        _ranked(first_n(cat.news_articles, LATEST, latest), latest),
        _names(cat.news_categories, "category_id", "category"),
        ["category_id"],
    )
    jobs = lookup_few(
        _ranked(first_n(cat.jobs, LATEST, recent), recent), _names(cat.companies, "company_id", "company"), ["company_id"]
    )
    tools = lookup_few(
        _ranked(first_n(cat.tools, FEATURED), by_id), _names(cat.tool_categories, "category_id", "category"), ["category_id"]
    )
    guides = lookup_few(
        _ranked(first_n(cat.knowledge_articles, LATEST, latest), latest),
        _names(cat.knowledge_categories, "category_id", "category"),
        ["category_id"],
    )
    companies = _ranked(first_n(cat.companies, FEATURED), by_id)

    def tag(kind: str) -> Column:
        return F.coalesce("category", F.lit(HOME_TAGS[kind]))

    none = F.lit(None).cast("string")
    salary = F.concat(F.lit("Salary: "), either(F.col("salary_range"), NO_SALARY))
    blocks = [
        news.select(*_card("news", tag("news"), "title", F.col("summary"), date_text(F.col("published_at"), LONG_DATE)), "rank"),
        tools.select(*_card("tools", tag("tools"), "name", F.col("description"), none), "rank"),
        jobs.select(*_card("jobs", shown("job_type"), "title", F.concat("company", F.lit(" — "), "location"), salary), "rank"),
        companies.select(*_card("companies", none, "name", none, none), "rank"),
        guides.select(
            *_card(
                "knowledge",
                tag("knowledge"),
                "title",
                F.col("summary"),
                F.concat(F.lit("Published: "), date_text(F.col("published_at"), SHORT_DATE)),
            ),
            "rank",
        ),
    ]
    return reduce(DataFrame.unionByName, blocks)


def inbox_latest(messages: DataFrame, n: int = INBOX) -> DataFrame:
    """The newest contact messages."""
    return (
        messages.orderBy(*newest_first("created_at"))
        .limit(n)
        .select("id", date_text(F.col("created_at"), DASH_TIME).alias("received"), "name", "email", "subject", "message")
    )


def article_list(articles: DataFrame, categories: DataFrame) -> DataFrame:
    """Editors' list of articles in every status, newest first."""
    return (
        with_category(articles, categories)
        .orderBy(*newest_first("created_at"))
        .select(
            "id",
            "title",
            F.coalesce("category", F.lit(NO_CATEGORY)).alias("category"),
            F.upper("status").alias("status"),
            date_text(F.col("published_at"), DASH_DATE, NO_DATE).alias("published"),
        )
    )


def job_list(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    return (
        jobs_with_company(jobs, companies)
        .orderBy(*newest_first("created_at"))
        .select("id", "title", "company", "location", "job_type", F.upper("status").alias("status"))
    )


def company_list(companies: DataFrame, categories: DataFrame) -> DataFrame:
    return (
        with_category(companies, categories)
        .orderBy(*newest_first("created_at"))
        .select(
            "id", "name", "slug", F.coalesce("category", F.lit(NO_CATEGORY)).alias("category"), F.upper("status").alias("status")
        )
    )


def media_list(media: DataFrame) -> DataFrame:
    """Stored files with a size and type label, newest first."""
    return media.orderBy(*newest_first("created_at")).select(
        "id", "filename", size_label(F.col("file_size"), F.col("file_type")).alias("label")
    )
