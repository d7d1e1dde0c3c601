"""Declared tables of the catalogue: columns, lengths, keys and value lists.

Fixed values: names, types, lengths and rules that the data must follow.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

LONG, BOOL, TEXT, TIME = T.LongType(), T.BooleanType(), T.StringType(), T.TimestampNTZType()

ARTICLE_STATUSES = ("draft", "review", "published", "archived")
LISTING_STATUSES = ("draft", "published", "archived")
JOB_TYPES = ("Full-time", "Part-time", "Contract", "Internship")

PUBLISHED = "published"


@dataclass(frozen=True)
class Table:
    """One table: ``columns`` maps a name to (type, max length or None, required)."""

    columns: dict[str, tuple[T.DataType, int | None, bool]]
    unique: tuple[tuple[str, ...], ...] = ()
    foreign_keys: dict[str, tuple[str, str]] = field(default_factory=dict)  # column -> (parent, on delete)
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def struct(self) -> T.StructType:
        out = T.StructType()
        for name, (kind, _, required) in self.columns.items():
            out = out.add(name, kind, not required)
        return out

    def required(self) -> list[str]:
        return [name for name, (_, _, required) in self.columns.items() if required]

    def lengths(self) -> dict[str, int]:
        return {name: size for name, (_, size, _) in self.columns.items() if size}


def _key() -> dict:
    return {"id": (LONG, None, True)}


def _times(updated: bool = True) -> dict:
    out = {"created_at": (TIME, None, True)}
    if updated:
        out["updated_at"] = (TIME, None, True)
    return out


def _seo(canonical: bool = False) -> dict:
    out = {"seo_title": (TEXT, 150, False), "seo_description": (TEXT, 255, False)}
    if canonical:
        out["canonical_url"] = (TEXT, 255, False)
    return out


def _category_table() -> Table:
    return Table(
        {
            **_key(),
            "name": (TEXT, 100, True),
            "slug": (TEXT, 100, True),
            "description": (TEXT, None, False),
            **_times(updated=False),
        },
        unique=(("name",), ("slug",)),
    )


def _article_table(categories: str) -> Table:
    return Table(
        {
            **_key(),
            "title": (TEXT, 255, True),
            "slug": (TEXT, 255, True),
            "summary": (TEXT, None, True),
            "content": (TEXT, None, True),
            "featured_image": (TEXT, 255, False),
            "category_id": (LONG, None, False),
            "author_id": (LONG, None, False),
            "status": (TEXT, 20, True),
            "published_at": (TIME, None, False),
            **_times(),
            **_seo(canonical=True),
        },
        unique=(("slug",),),
        foreign_keys={"category_id": (categories, "set null"), "author_id": ("users", "set null")},
        domains={"status": ARTICLE_STATUSES},
    )


def _bridge(owner: str, parent: str) -> Table:
    return Table(
        {owner: (LONG, None, True), "tag_id": (LONG, None, True)},
        unique=((owner, "tag_id"),),
        foreign_keys={owner: (parent, "cascade"), "tag_id": ("tags", "cascade")},
    )


TABLES: dict[str, Table] = {
    "users": Table(
        {
            **_key(),
            "username": (TEXT, 64, True),
            "email": (TEXT, 120, True),
            "password_hash": (TEXT, 256, True),
            "is_active": (BOOL, None, True),
            **_times(),
        },
        unique=(("username",), ("email",)),
    ),
    "tags": Table(
        {**_key(), "name": (TEXT, 50, True), "slug": (TEXT, 50, True), **_times(updated=False)},
        unique=(("name",), ("slug",)),
    ),
    "news_tags": _bridge("news_id", "news_articles"),
    "knowledge_tags": _bridge("knowledge_id", "knowledge_articles"),
    "news_categories": _category_table(),
    "knowledge_categories": _category_table(),
    "company_categories": _category_table(),
    "tool_categories": _category_table(),
    "news_articles": _article_table("news_categories"),
    "knowledge_articles": _article_table("knowledge_categories"),
    "companies": Table(
        {
            **_key(),
            "name": (TEXT, 255, True),
            "slug": (TEXT, 255, True),
            "description": (TEXT, None, True),
            "logo": (TEXT, 255, False),
            "category_id": (LONG, None, False),
            "website": (TEXT, 255, False),
            "email": (TEXT, 120, False),
            "phone": (TEXT, 50, False),
            "address": (TEXT, None, False),
            "status": (TEXT, 20, True),
            **_times(),
            **_seo(),
        },
        unique=(("slug",),),
        foreign_keys={"category_id": ("company_categories", "set null")},
        domains={"status": LISTING_STATUSES},
    ),
    "jobs": Table(
        {
            **_key(),
            "title": (TEXT, 255, True),
            "slug": (TEXT, 255, True),
            "description": (TEXT, None, True),
            "company_id": (LONG, None, True),
            "location": (TEXT, 150, True),
            "salary_range": (TEXT, 100, False),
            "job_type": (TEXT, 50, False),
            "status": (TEXT, 20, True),
            **_times(),
            **_seo(),
        },
        unique=(("slug",),),
        foreign_keys={"company_id": ("companies", "cascade")},
        domains={"status": LISTING_STATUSES, "job_type": JOB_TYPES},
    ),
    "services": Table(
        {
            **_key(),
            "name": (TEXT, 255, True),
            "slug": (TEXT, 255, True),
            "description": (TEXT, None, True),
            "provider_id": (LONG, None, True),
            "status": (TEXT, 20, True),
            **_times(),
        },
        unique=(("slug",),),
        foreign_keys={"provider_id": ("companies", "cascade")},
        domains={"status": LISTING_STATUSES},
    ),
    "tools": Table(
        {
            **_key(),
            "name": (TEXT, 255, True),
            "slug": (TEXT, 255, True),
            "description": (TEXT, None, True),
            "category_id": (LONG, None, False),
            "status": (TEXT, 20, True),
            **_times(),
            **_seo(),
        },
        unique=(("slug",),),
        foreign_keys={"category_id": ("tool_categories", "set null")},
        domains={"status": LISTING_STATUSES},
    ),
    "media": Table(
        {
            **_key(),
            "filename": (TEXT, 255, True),
            "filepath": (TEXT, 255, True),
            "file_type": (TEXT, 50, False),
            "file_size": (LONG, None, False),
            "uploaded_by_id": (LONG, None, False),
            **_times(updated=False),
        },
        foreign_keys={"uploaded_by_id": ("users", "set null")},
    ),
    "contact_messages": Table(
        {
            **_key(),
            "name": (TEXT, 100, True),
            "email": (TEXT, 120, True),
            "subject": (TEXT, 150, True),
            "message": (TEXT, None, True),
            "is_read": (BOOL, None, True),
            **_times(updated=False),
        },
    ),
}

# Columns that get a Tamil text and its English rendering, per table.
_CATEGORY_TEXTS = ("name", "description")
_ARTICLE_TEXTS = ("title", "summary", "content", "seo_title", "seo_description")
TRANSLATED: dict[str, tuple[str, ...]] = {
    "companies": ("name", "description", "address", "seo_title", "seo_description"),
    "company_categories": _CATEGORY_TEXTS,
    "jobs": ("title", "description", "seo_title", "seo_description"),
    "knowledge_articles": _ARTICLE_TEXTS,
    "knowledge_categories": _CATEGORY_TEXTS,
    "news_articles": _ARTICLE_TEXTS,
    "news_categories": _CATEGORY_TEXTS,
    "services": ("name", "description"),
    "tool_categories": _CATEGORY_TEXTS,
    "tools": ("name", "description", "seo_title", "seo_description"),
}
TRANSLATION_SUFFIXES = ("_ta", "_ta_en")
