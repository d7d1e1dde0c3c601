"""What pages and search engines show of an item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LONG_DATE, SHORT_DATE, date_text, either, head, iso_text, line_breaks, link, shown
from .feeds import jobs_with_company, published, services_with_provider, with_author, with_category

# Endings of page titles; {site} and {place} are filled in by the caller.
TITLE_ENDINGS = {
    "news": " — {site} News",
    "knowledge": " — Garment Knowledge",
    "jobs": " — Garment Jobs {place}",
    "companies": " — Garment Manufacturer",
    "services": " — Textile Service",
}
DESCRIPTION_SIZE = 150

# Tags shown for items without a category, per place they are shown in.
HOME_TAGS = {"news": "General", "tools": "Tool", "knowledge": "Guide"}
LIST_TAGS = {"news": "News", "knowledge": "Guide", "companies": "Manufacturer"}
DETAIL_TAGS = {"news": "General", "knowledge": "Garment Guide", "companies": "Company"}
SERVICE_TAG = "Industrial Service"
NO_SALARY = "Negotiable"

# Schema.org types, names for articles without an author (page, record).
RECORD_TYPES = {"news": "NewsArticle", "knowledge": "TechArticle"}
PAGE_AUTHORS = {"news": "Staff Reporter", "knowledge": "Technical Expert"}
RECORD_AUTHORS = {"news": "{site} Editor", "knowledge": "{site} Specialist"}


def page_metadata(kind: str, items: DataFrame, site: str = "", place: str = "") -> DataFrame:
    """Title and description of each published item's page: the own ones, or made ones."""
    title = F.col("title" if "title" in items.columns else "name")
    text = F.col("summary") if "summary" in items.columns else head(F.col("description"), DESCRIPTION_SIZE)
    if "seo_title" in items.columns:
        title, text = either(F.col("seo_title"), title), either(F.col("seo_description"), text)
    ending = TITLE_ENDINGS[kind].format(site=site, place=place).rstrip()
    return published(items).select(
        F.lit(kind).alias("kind"),
        "id",
        F.concat(title, F.lit(ending)).alias("page_title"),
        text.alias("meta_description"),
    )


def structured_data(kind: str, articles: DataFrame, users: DataFrame, site: str = "") -> DataFrame:
    """The schema.org record of each published article as JSON text (properly escaped)."""
    fallback = RECORD_AUTHORS[kind].format(site=site).strip()
    record = F.struct(
        F.lit("https://schema.org").alias("@context"),
        F.lit(RECORD_TYPES[kind]).alias("@type"),
        F.col("title").alias("headline"),
        F.col("summary").alias("description"),
        F.coalesce(iso_text(F.col("published_at")), F.lit("")).alias("datePublished"),
        F.coalesce(iso_text(F.col("updated_at")), F.lit("")).alias("dateModified"),
        F.struct(F.lit("Person").alias("@type"), F.col("author").alias("name")).alias("author"),
    )
    return with_author(published(articles), users, fallback).select(
        F.lit(kind).alias("kind"), "id", F.to_json(record).alias("record")
    )


def _card(kind: str, tag: Column, title: str, teaser: Column, note: Column) -> list[Column]:
    return [
        F.lit(kind).alias("kind"),
        F.col("id"),
        tag.alias("tag"),
        F.col(title).alias("title"),
        link("", kind, F.col("slug")).alias("link"),
        teaser.alias("teaser"),
        note.alias("note"),
    ]


def article_cards(
    kind: str, articles: DataFrame, categories: DataFrame, tag: str, pattern: str = SHORT_DATE, prefix: str = ""
) -> DataFrame:
    """Cards of news or guides; the note is the date, empty if there is none."""
    note = F.concat(F.lit(prefix), date_text(F.col("published_at"), pattern))
    return with_category(articles, categories).select(
        *_card(kind, F.coalesce("category", F.lit(tag)), "title", F.col("summary"), note), "published_at"
    )


def job_cards(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    teaser = F.concat("company", F.lit(" — "), "location")
    note = F.concat(F.lit("Salary: "), either(F.col("salary_range"), NO_SALARY))
    return jobs_with_company(jobs, companies).select(
        *_card("jobs", shown("job_type"), "title", teaser, note), "created_at"
    )


def company_cards(companies: DataFrame, categories: DataFrame) -> DataFrame:
    return with_category(companies, categories).select(
        *_card(
            "companies",
            F.coalesce("category", F.lit(LIST_TAGS["companies"])),
            "name",
            head(F.col("description"), 120, "..."),
            F.concat(F.lit("📍 "), shown("address")),
        )
    )


def service_cards(services: DataFrame, companies: DataFrame) -> DataFrame:
    note = F.concat(F.lit("Provider: "), F.col("provider"))
    return services_with_provider(services, companies).select(
        *_card("services", F.lit(SERVICE_TAG), "name", head(F.col("description"), 150, "..."), note)
    )


def tool_cards(tools: DataFrame, categories: DataFrame) -> DataFrame:
    return with_category(tools, categories).select(
        *_card(
            "tools",
            F.coalesce("category", F.lit(HOME_TAGS["tools"])),
            "name",
            F.col("description"),
            F.lit(None).cast("string"),
        )
    )


def article_pages(kind: str, articles: DataFrame, categories: DataFrame, users: DataFrame) -> DataFrame:
    """Body of each published article's own page: tag, author, date and text with line breaks."""
    full = with_author(with_category(published(articles), categories), users, PAGE_AUTHORS[kind])
    return full.select(
        F.lit(kind).alias("kind"),
        "id",
        F.coalesce("category", F.lit(DETAIL_TAGS[kind])).alias("tag"),
        "title",
        "author",
        date_text(F.col("published_at"), LONG_DATE).alias("published"),
        line_breaks(F.col("content")).alias("body"),
    )


def job_pages(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Each published job's own page."""
    return jobs_with_company(published(jobs), companies).select(
        "id",
        shown("job_type").alias("tag"),
        "title",
        "company",
        link("", "companies", F.col("company_slug")).alias("company_link"),
        "location",
        either(F.col("salary_range"), NO_SALARY).alias("salary"),
        date_text(F.col("created_at"), LONG_DATE).alias("posted"),
        line_breaks(F.col("description")).alias("body"),
    )


def company_pages(companies: DataFrame, categories: DataFrame) -> DataFrame:
    """Each published company's own page; contact lines without a value are left out (NULL)."""
    contacts = [F.nullif(F.col(c), F.lit("")).alias(c) for c in ("website", "email", "phone")]
    return with_category(published(companies), categories).select(
        "id",
        F.coalesce("category", F.lit(DETAIL_TAGS["companies"])).alias("tag"),
        "name",
        *contacts,
        line_breaks(F.col("description")).alias("body"),
    )


def service_pages(services: DataFrame, companies: DataFrame) -> DataFrame:
    """Each published service's own page."""
    return services_with_provider(published(services), companies).select(
        "id",
        "name",
        "provider",
        link("", "companies", F.col("provider_slug")).alias("provider_link"),
        line_breaks(F.col("description")).alias("body"),
    )


def all_cards(cat) -> DataFrame:
    """Cards of the six list pages over all published items."""
    drop = ("published_at", "created_at")
    parts = [
        article_cards("news", published(cat.news_articles), cat.news_categories, LIST_TAGS["news"]),
        article_cards("knowledge", published(cat.knowledge_articles), cat.knowledge_categories, LIST_TAGS["knowledge"]),
        job_cards(published(cat.jobs), cat.companies),
        company_cards(published(cat.companies), cat.company_categories),
        service_cards(published(cat.services), cat.companies),
        tool_cards(published(cat.tools), cat.tool_categories),
    ]
    out = parts[0].drop(*drop)
    for part in parts[1:]:
        out = out.unionByName(part.drop(*drop))
    return out
