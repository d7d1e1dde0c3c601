"""Related items, profiles and the ways from parents to their children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .feeds import published
from .lookup import child_counts, lookup_join

# Items shown beside one.
RELATED = 3
GUIDES = 2


def _group_heads(items: DataFrame, n: int, fields: list[str]) -> DataFrame:
    """The first ``n + 1`` items of every group, as one array per group.

    An item is left out of its own list, so ``n + 1`` are enough for every member.  Spark
    cuts each group to that size before the shuffle, however large the group is.
    """
    by_group = Window.partitionBy("__group", "__no_group").orderBy("id")
    return (
        items.withColumn("__rank", F.row_number().over(by_group))
        .where(F.col("__rank") <= n + 1)
        .groupBy("__group", "__no_group")
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("__heads"))
    )


def with_related(items: DataFrame, group: str, title: str, n: int = RELATED, **options) -> DataFrame:
    """Published items with ``related``: up to ``n`` others of the same group, lowest ids first.

    Items without a group form a group of their own.  Each item looks up its group's short
    list; pairs within a group are never formed.
    """
    keyed = published(items).select(
        "id",
        F.col(title).alias("title"),
        "slug",
        F.coalesce(F.col(group), F.lit(0)).alias("__group"),
        F.col(group).isNull().alias("__no_group"),
    )
    heads = _group_heads(keyed, n, ["id", "title", "slug"])
    others = F.slice(F.filter("__heads", lambda other: other["id"] != F.col("id")), 1, n)
    return lookup_join(keyed, heads, ["__group", "__no_group"], "inner", **options).select(
        "id", "title", "slug", others.alias("related")
    )


def related_items(items: DataFrame, group: str, title: str, n: int = RELATED, **options) -> DataFrame:
    """One row per item and related item, with its rank from 1."""
    return with_related(items, group, title, n, **options).select(
        "id", F.posexplode("related").alias("rank", "other")
    ).select(
        "id",
        (F.col("rank") + 1).alias("rank"),
        F.col("other.id").alias("related_id"),
        F.col("other.title").alias("related_title"),
        F.col("other.slug").alias("related_slug"),
    )


def tool_pages(tools: DataFrame, guides: DataFrame, n_guides: int = GUIDES, **options) -> DataFrame:
    """Each published tool with its related tools and the same first guides.

    The guides do not depend on the tool: they are one value, computed once.
    """
    first = published(guides).orderBy("id").limit(n_guides)
    shown = first.agg(
        F.array_sort(F.collect_list(F.struct("id", "title", "slug"))).alias("guides")
    ).scalar()
    return with_related(tools, "category_id", "name", **options).withColumn("guides", shown)


def joined_texts(array: Column, part: str) -> Column:
    """One field of an array of structs as text, parts separated by '|'."""
    return F.array_join(F.transform(array, lambda x: x[part].cast("string")), "|")


def company_profiles(companies: DataFrame, jobs: DataFrame, services: DataFrame, **options) -> DataFrame:
    """Published companies with their published jobs and services, in long form.

    Section 'company' has one row per company with the two counts; 'jobs' and 'services'
    have one row per item.  A company may own a large part of all jobs, so its jobs are
    never gathered into one value.
    """
    shown = published(companies).select(F.col("id").alias("company_id"), F.col("name").alias("company"), "slug")
    own_jobs, own_services = published(jobs), published(services)
    n_jobs = child_counts(own_jobs, "company_id", "n_jobs")
    n_services = child_counts(own_services, "provider_id", "n_services").withColumnRenamed("provider_id", "company_id")
    names = shown.select("company_id", "company")

    def rows(df: DataFrame, section: str, title: str, detail: Column, counts: bool = False) -> DataFrame:
        none = F.lit(None).cast("bigint")
        return df.select(
            "company_id",
            "company",
            F.lit(section).alias("section"),
            (F.col("company_id") if counts else F.col("id")).alias("item_id"),
            F.col(title).alias("title"),
            "slug",
            detail.alias("detail"),
            (F.coalesce("n_jobs", F.lit(0)) if counts else none).alias("n_jobs"),
            (F.coalesce("n_services", F.lit(0)) if counts else none).alias("n_services"),
        )

    head_rows = shown.join(n_jobs, "company_id", "left").join(n_services, "company_id", "left")
    job_rows = lookup_join(own_jobs, names, ["company_id"], "inner", **options)
    service_rows = lookup_join(
        own_services.withColumnRenamed("provider_id", "company_id").withColumnRenamed("name", "service"),
        names,
        ["company_id"],
        "inner",
        **options,
    )
    return (
        rows(head_rows, "company", "company", F.lit(None).cast("string"), counts=True)
        .unionByName(rows(job_rows, "jobs", "title", F.concat_ws(" | ", "job_type", "location")))
        .unionByName(rows(service_rows, "services", "service", F.substring("description", 1, 100)))
    )


def article_tags(articles: DataFrame, bridge: DataFrame, owner: str, tags: DataFrame, **options) -> DataFrame:
    """Published articles and their tags, one row per pair, in both directions.

    A tag may be on a large part of all articles, so neither side is gathered.
    """
    names = tags.select(F.col("id").alias("tag_id"), F.col("name").alias("tag"))
    items = published(articles).select(F.col("id").alias(owner), "title", "slug")
    pairs = lookup_join(bridge.select(owner, "tag_id"), items, [owner], "inner", **options)
    return lookup_join(pairs, names, ["tag_id"], "inner", **options).select(
        F.col(owner).alias("article_id"), "title", "slug", "tag_id", "tag"
    )


def children_of(parents: DataFrame, children: DataFrame, key: str, relation: str, **options) -> DataFrame:
    """All children under their parent, and one row without a child for each childless parent."""
    parent_ids = parents.select(F.col("id").alias("parent_id"))
    child_ids = children.select(F.col(key).alias("parent_id"), F.col("id").alias("child_id"))
    having = child_counts(child_ids, "parent_id").select("parent_id")
    linked = lookup_join(child_ids, parent_ids, ["parent_id"], "inner", **options)
    alone = parent_ids.join(having, "parent_id", "left_anti").withColumn("child_id", F.lit(None).cast("bigint"))
    return linked.unionByName(alone).select(F.lit(relation).alias("relation"), "parent_id", "child_id")


def children_counts(parents: DataFrame, children: DataFrame, key: str, relation: str) -> DataFrame:
    """Number of children, lowest and highest child id of every parent, 0 where there is none."""
    sums = (
        children.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("parent_id"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    )
    return (
        parents.select(F.col("id").alias("parent_id"))
        .join(sums, "parent_id", "left")
        .select(
            F.lit(relation).alias("relation"),
            "parent_id",
            F.coalesce("n", F.lit(0)).alias("children"),
            "first_id",
            "last_id",
        )
    )


# Relation name -> (parent table, child table, key column of the child).
REVERSE = {
    "news of category": ("news_categories", "news_articles", "category_id"),
    "guides of category": ("knowledge_categories", "knowledge_articles", "category_id"),
    "companies of category": ("company_categories", "companies", "category_id"),
    "tools of category": ("tool_categories", "tools", "category_id"),
    "news of author": ("users", "news_articles", "author_id"),
    "guides of author": ("users", "knowledge_articles", "author_id"),
    "media of user": ("users", "media", "uploaded_by_id"),
    "jobs of company": ("companies", "jobs", "company_id"),
    "services of company": ("companies", "services", "provider_id"),
}


def every_relation(cat, build) -> DataFrame:
    """``build`` (children_of or children_counts) over all relations of the catalogue."""
    parts = [
        build(getattr(cat, parent), getattr(cat, child), key, relation)
        for relation, (parent, child, key) in REVERSE.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
