"""Every query by name: ``QUERIES[name](spark, sf_dir)`` over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import fixed_text, read_number, read_whole
from ..functions.slugs import slug_of
from ..operators import (
    changes,
    costing,
    dashboard,
    feeds,
    intake,
    integrity,
    pageindex,
    pages,
    paging,
    relations,
    routing,
    search,
    sitemap,
    textindex,
)
from ..schemas import JOB_TYPES, LISTING_STATUSES, TABLES
from ..session import run_folder
from ..sources import blocks
from ..sources.catalogue import read_catalogue, write_catalogue, write_checked
from ..sources import colocated, pointfiles
from ..sources.exports import json_record, read_sitemap, write_feed, write_sitemap
from ..sources.sitemapshards import read_sharded_sitemap, update_sitemap
from ..sources.testviews import RAW_COLUMNS, Catalogue, from_events
from ..streaming import contact

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# Parameters of the registered queries.
WORD = "the"
SITE, PLACE, BASE = "Example", "Anytown", "https://example.org/"
CATEGORY = "asia"
PAGE = 3
BLOCK_BITS = 10  # ids of a stored block
PAGE_RANGE = 1000  # rows of a page index range
ROUTES = (("benchmark", ("ther", "ing")), ("costing", ("der",)), ("fabric", ("ion", "ment")))
# Limits for which the test tables hold rows that break them.
TITLE_LIMIT, SLUG_LIMIT = 50, 6
ALLOWED_STATUSES = ("published", "draft")


def query(name: str):
    def add(build: Callable[[Catalogue], DataFrame]) -> Callable[[Catalogue], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(Catalogue(spark, sf_dir))
        return build

    return add


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _kind(kind: str, df: DataFrame, *columns) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), *columns)


# ---------------------------------------------------------------- sources and sinks


@query("scan_catalogue")
def scan_catalogue(cat):
    """Every table in its declared columns: rows, and how many values are missing."""
    parts = []
    for name, table in TABLES.items():
        df = getattr(cat, name)
        held = [c for c in table.columns if c in df.columns]
        missing = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in held])
        parts.append(df.agg(F.count(F.lit(1)).alias("n"), missing.alias("missing")).select(
            F.lit(name).alias("table_name"), "n", "missing"))
    return _union(parts)


def _stored(cat):
    """The whole catalogue written to the work folder and opened again."""
    root = run_folder(cat.spark, "catalogue")
    write_catalogue(cat, root)
    return read_catalogue(cat.spark, root)


@query("stored_roundtrip")
def stored_roundtrip(cat):
    """Every table stored in its declared columns and read back: rows and missing values."""
    stored, parts = _stored(cat), []
    for name, table in TABLES.items():
        missing = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in table.columns])
        parts.append(getattr(stored, name).agg(F.count(F.lit(1)).alias("n"), missing.alias("missing")).select(
            F.lit(name).alias("table_name"), "n", "missing"))
    return _union(parts)


@query("stored_homepage")
def stored_homepage(cat):
    return dashboard.homepage(_stored(cat))


@query("stored_search_all")
def stored_search_all(cat):
    return search.search_all(_stored(cat), WORD)


@query("feed_json_export")
def feed_json_export(cat):
    feed = feeds.job_feed(cat.jobs, cat.companies)
    return feed.select("id", json_record(feed).alias("record"))


@query("feed_json_files")
def feed_json_files(cat):
    """A feed written as files of JSON lines and read back."""
    feed = feeds.company_feed(cat.companies, cat.company_categories)
    path = run_folder(cat.spark, "feed")
    write_feed(feed, path)
    return cat.spark.read.schema(feed.schema).json(path)


@query("sitemap_export")
def sitemap_export(cat):
    """The site map written as XML files and read back."""
    path = run_folder(cat.spark, "sitemap")
    write_sitemap(sitemap.sitemap(cat, BASE), path)
    return read_sitemap(cat.spark, path)


@query("sitemap_by_change")
def sitemap_by_change(cat):
    """The site map kept in shards: first written without the jobs, then brought to all addresses, and read back."""
    path, urls = run_folder(cat.spark, "sitemap-shards"), sitemap.sitemap(cat, BASE)
    update_sitemap(urls.where(~F.col("loc").contains("/jobs/")), path, BASE)
    update_sitemap(urls, path, BASE)
    return read_sharded_sitemap(cat.spark, path)


@query("seed_insert_if_absent")
def seed_insert_if_absent(cat):
    """Suppliers and customers entered as users where customers already are."""
    customers = cat.companies.selectExpr("id", "name AS username")
    offered = cat.users.selectExpr("id", "username").unionByName(customers)
    return changes.insert_absent(customers, offered, "username")


@query("media_intake")
def media_intake(cat):
    return intake.media_rows(intake.check_uploads(cat.media))


# ---------------------------------------------------------------- projections


@query("feed_news")
def feed_news(cat):
    return feeds.article_feed(cat.news_articles, cat.news_categories)


@query("feed_knowledge")
def feed_knowledge(cat):
    return feeds.article_feed(cat.knowledge_articles, cat.knowledge_categories)


@query("feed_jobs")
def feed_jobs(cat):
    return feeds.job_feed(cat.jobs, cat.companies)


@query("feed_companies")
def feed_companies(cat):
    return feeds.company_feed(cat.companies, cat.company_categories)


@query("feed_services")
def feed_services(cat):
    return feeds.service_feed(cat.services, cat.companies)


@query("feed_tools")
def feed_tools(cat):
    return feeds.tool_feed(cat.tools, cat.tool_categories)


@query("seo_metadata")
def seo_metadata(cat):
    tables = {
        "news": cat.news_articles,
        "knowledge": cat.knowledge_articles,
        "jobs": cat.jobs,
        "companies": cat.companies,
        "services": cat.services,
    }
    return _union([pages.page_metadata(kind, df, SITE, PLACE) for kind, df in tables.items()])


@query("structured_data")
def structured_data(cat):
    return pages.structured_data("news", cat.news_articles, cat.users, SITE).unionByName(
        pages.structured_data("knowledge", cat.knowledge_articles, cat.users, SITE)
    )


@query("cards")
def cards(cat):
    return pages.all_cards(cat)


@query("article_pages")
def article_pages(cat):
    return pages.article_pages("news", cat.news_articles, cat.news_categories, cat.users).unionByName(
        pages.article_pages("knowledge", cat.knowledge_articles, cat.knowledge_categories, cat.users)
    )


@query("job_pages")
def job_pages(cat):
    return pages.job_pages(cat.jobs, cat.companies)


@query("company_pages")
def company_pages(cat):
    return pages.company_pages(cat.companies, cat.company_categories)


@query("service_pages")
def service_pages(cat):
    return pages.service_pages(cat.services, cat.companies)


@query("localised_columns")
def localised_columns(cat):
    """Tools stored with and without translation columns, merged, with the text to show."""
    old = cat.tools.select("id", "name", "description")
    new = changes.add_translations(
        cat.services.select("id", "name", "description"), "services"
    ).withColumn("name_ta", F.concat(F.lit("ta "), "name"))
    merged = changes.merge_batches(old, new)
    return merged.withColumn("shown", changes.localised(merged, "services", "name"))


# ---------------------------------------------------------------- filters


@query("published_only")
def published_only(cat):
    tables = {
        "news": cat.news_articles,
        "knowledge": cat.knowledge_articles,
        "jobs": cat.jobs,
        "companies": cat.companies,
        "services": cat.services,
        "tools": cat.tools,
    }
    return _union([_kind(kind, feeds.published(df), "id", "slug") for kind, df in tables.items()])


@query("slug_lookup")
def slug_lookup(cat):
    """The company page of every event's user: most requests repeat."""
    requests = cat.contact_messages.selectExpr("id AS request_id", "concat('c-', substring(email, 2, instr(email, '@') - 2)) AS slug")
    return feeds.find_by_slug(requests, cat.companies)


@query("category_feed")
def category_feed(cat):
    return (
        feeds.in_category(cat.news_articles, cat.news_categories, CATEGORY)
        .orderBy(*feeds.newest_first("published_at"))
        .select("id", "title", "slug", "category", "published_at")
    )


@query("category_feed_knowledge")
def category_feed_knowledge(cat):
    """The second page of a category's guides."""
    guides = feeds.in_category(cat.knowledge_articles, cat.knowledge_categories, CATEGORY)
    page = paging.page_of(guides, feeds.newest_first("published_at"), 2)
    return page.select("id", "title", "slug", "category", "published_at")


@query("category_feed_tools")
def category_feed_tools(cat):
    return feeds.in_category(cat.tools, cat.tool_categories, CATEGORY).select("id", "name", "slug", "category")


@query("slug_points")
def slug_points(cat):
    """Companies found by slug, and then by id, in a table stored for point look-ups; the asked ones are the busiest posters."""
    path = run_folder(cat.spark, "points")
    pointfiles.write_points(cat.companies, path, ["slug", "id"])
    busiest = cat.jobs.where("company_id IS NOT NULL").groupBy("company_id").count().orderBy(F.desc("count"), "company_id").limit(5)
    ids = [row.company_id for row in busiest.collect()]
    by_id = pointfiles.find_points(cat.spark, path, cat.companies.schema, "id", [*ids, -1])
    slugs = [row.slug for row in by_id.select("slug").collect()]
    by_slug = pointfiles.find_points(cat.spark, path, cat.companies.schema, "slug", [*slugs, "nowhere", None])
    return _union([_kind(kind, df, "id", "slug", "name") for kind, df in (("id", by_id), ("slug", by_slug))])


@query("feed_record_by_slug")
def feed_record_by_slug(cat):
    """The feed's record for every asked slug: one per labelled document, page and part."""
    asked = {
        "news": (feeds.article_feed(cat.news_articles, cat.news_categories), cat.article_edits.select("slug").distinct(), "title"),
        "knowledge": (
            feeds.article_feed(cat.knowledge_articles, cat.knowledge_categories),
            cat.article_deletes.selectExpr("concat('page-', id) AS slug"), "title",
        ),
        "tools": (feeds.tool_feed(cat.tools, cat.tool_categories), cat.companies.selectExpr("concat('t-', id) AS slug"), "name"),
    }
    return _union([
        _kind(kind, feeds.records_by_slug(slugs, feed), "slug", "found", F.col(name).alias("title"), "category")
        for kind, (feed, slugs, name) in asked.items()
    ])


# A word that occurs in the test rows of each kind.
WORDS = {"news": WORD, "knowledge": WORD, "jobs": "URGE", "companies": "build", "tools": "brand#1"}


def _keyword_search(kind: str):
    return lambda cat: search.search_results(kind, cat, WORDS[kind])


for _kind_name in search.SEARCHED:
    query(f"keyword_search_{_kind_name}")(_keyword_search(_kind_name))


# Searches with wildcards and without a trigram beside the words above.
INDEXED = [*WORDS.items(), ("news", "th%ing"), ("knowledge", "t_e r"), ("tools", "d#"), ("companies", "ld_ng%"), ("jobs", "gen")]


def keyword_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches by the trigram index; the index is written first."""
    cat = Catalogue(spark, sf_dir)
    root = run_folder(spark, "text-index")
    textindex.write_index(cat, root, buckets=16)
    index = textindex.TextIndex(spark, root, buckets=16)
    return _union([
        search.as_results(kind, cat, index.search(kind, word)).withColumn("query", F.lit(word))
        for kind, word in INDEXED
    ])


QUERIES["keyword_search_indexed"] = keyword_search_indexed


@query("contact_required")
def contact_required(cat):
    return intake.check_messages(cat.contact_messages)


@query("media_accept")
def media_accept(cat):
    return intake.check_uploads(cat.media).select("id", "file_size", "file_type", "extension", "reject_reason")


# ---------------------------------------------------------------- joins


@query("with_category")
def with_category(cat):
    tables = {
        "news": (cat.news_articles, cat.news_categories),
        "knowledge": (cat.knowledge_articles, cat.knowledge_categories),
        "companies": (cat.companies, cat.company_categories),
        "tools": (cat.tools, cat.tool_categories),
    }
    return _union(
        [_kind(kind, feeds.with_category(df, names), "id", "category_id", "category") for kind, (df, names) in tables.items()]
    )


@query("with_author")
def with_author(cat):
    tables = {"news": cat.news_articles, "knowledge": cat.knowledge_articles}
    return _union(
        [_kind(k, feeds.with_author(df, cat.users, pages.PAGE_AUTHORS[k]), "id", "author") for k, df in tables.items()]
    )


_JOB_COLUMNS = ("id", "title", "company_id", "company", "company_slug")


@query("jobs_with_company")
def jobs_with_company(cat):
    return feeds.jobs_with_company(cat.jobs, cat.companies).select(*_JOB_COLUMNS)


@query("jobs_with_company_spread")
def jobs_with_company_spread(cat):
    """The plan for a company table too large to broadcast."""
    return feeds.jobs_with_company(cat.jobs, cat.companies, broadcast_bytes=0).select(*_JOB_COLUMNS)


@query("services_with_provider")
def services_with_provider(cat):
    return feeds.services_with_provider(cat.services, cat.companies).select(
        "id", "name", "provider_id", "provider", "provider_slug"
    )


@query("related_news")
def related_news(cat):
    return relations.related_items(cat.news_articles, "category_id", "title")


@query("related_knowledge")
def related_knowledge(cat):
    return relations.related_items(cat.knowledge_articles, "category_id", "title")


@query("related_jobs")
def related_jobs(cat):
    return relations.related_items(cat.jobs, "company_id", "title")


@query("related_jobs_spread")
def related_jobs_spread(cat):
    return relations.related_items(cat.jobs, "company_id", "title", broadcast_bytes=0)


@query("related_tools")
def related_tools(cat):
    return relations.related_items(cat.tools, "category_id", "name")


@query("company_profile")
def company_profile(cat):
    return relations.company_profiles(cat.companies, cat.jobs, cat.services)


@query("articles_with_tags")
def articles_with_tags(cat):
    return _kind("news", relations.article_tags(cat.news_articles, cat.news_tags, "news_id", cat.tags), "*").unionByName(
        _kind("knowledge", relations.article_tags(cat.knowledge_articles, cat.knowledge_tags, "knowledge_id", cat.tags), "*")
    )


@query("tool_page_bundle")
def tool_page_bundle(cat):
    return relations.tool_pages(cat.tools, cat.knowledge_articles).select(
        "id",
        "slug",
        relations.joined_texts(F.col("related"), "slug").alias("related_slugs"),
        relations.joined_texts(F.col("related"), "title").alias("related_names"),
        relations.joined_texts(F.col("guides"), "slug").alias("guide_slugs"),
    )


@query("reverse_relations")
def reverse_relations(cat):
    return relations.every_relation(cat, relations.children_of)


@query("reverse_relation_counts")
def reverse_relation_counts(cat):
    return relations.every_relation(cat, relations.children_counts)


OWNER_BUCKETS = 8  # of these test tables; a large run takes about its largest table divided by 500 MB


def _by_owner(cat, **keys):
    """Some tables stored in buckets of their owner's key and opened again."""
    root = run_folder(cat.spark, "colocated")
    for name, key in keys.items():
        colocated.write_colocated(getattr(cat, name), f"{root}/{name}", key, OWNER_BUCKETS)
    return [colocated.Colocated(cat.spark, f"{root}/{name}") for name in keys]


@query("jobs_with_company_colocated")
def jobs_with_company_colocated(cat):
    """Jobs with their company from tables that lie in the same buckets; jobs without a company come as they are."""
    companies, jobs = _by_owner(cat, companies="id", jobs="company_id")
    owned = colocated.by_owner(lambda c, j: feeds.jobs_with_company(j, c).select(*_JOB_COLUMNS), companies, jobs)
    none = F.lit(None).cast("string")
    alone = colocated.without_key(jobs).withColumns({"company": none, "company_slug": none})
    return owned.unionByName(alone.select(*_JOB_COLUMNS))


@query("company_profile_colocated")
def company_profile_colocated(cat):
    """Company profiles from companies, jobs and services in the same buckets."""
    return colocated.by_owner(relations.company_profiles, *_by_owner(cat, companies="id", jobs="company_id", services="provider_id"))


@query("reverse_relations_colocated")
def reverse_relations_colocated(cat):
    """The ways from companies to their jobs and services, from the same buckets: every pair."""
    companies, *owned = _by_owner(cat, companies="id", jobs="company_id", services="provider_id")
    return _union([
        colocated.by_owner(lambda p, c, key=child.key, name=name: relations.children_of(p, c, key, name), companies, child)
        for name, child in zip(("jobs of company", "services of company"), owned)
    ])


# ---------------------------------------------------------------- counts, pages, top-k


@query("dashboard_counts")
def dashboard_counts(cat):
    return dashboard.dashboard_counts(cat)


@query("page_counts")
def page_counts(cat):
    return paging.page_counts(
        {"news": cat.news_articles, "knowledge": cat.knowledge_articles, "jobs": cat.jobs, "companies": cat.companies}
    )


@query("search_totals")
def search_totals(cat):
    return search.search_totals(cat, WORD)


@query("paged_feed")
def paged_feed(cat):
    jobs = feeds.published(cat.jobs).select("id", "title", "slug", "created_at")
    return pageindex.PageIndex.build(jobs, "created_at", PAGE_RANGE).all_pages()


@query("page_of_feed")
def page_of_feed(cat):
    order = feeds.newest_first("published_at")
    return paging.page_of(feeds.published(cat.news_articles), order, PAGE).select("id", "title", "published_at")


def page_of_feed_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same page by a stored page index, as for pages far back."""
    items = feeds.published(Catalogue(spark, sf_dir).news_articles).select("id", "title", "published_at")
    path = run_folder(spark, "page-index")
    pageindex.PageIndex.build(items, "published_at", PAGE_RANGE).save(path)
    page = pageindex.PageIndex.load(items, "published_at", path, PAGE_RANGE).page(PAGE)
    place = paging.place_on_page(feeds.newest_first("published_at"))
    return page.withColumn("position", place + (PAGE - 1) * paging.PER_PAGE)


QUERIES["page_of_feed_deep"] = page_of_feed_deep


@query("latest_published")
def latest_published(cat):
    order = feeds.newest_first("published_at")
    tables = {"news": cat.news_articles, "knowledge": cat.knowledge_articles}
    return _union([_kind(k, feeds.first_n(df, dashboard.LATEST, order), "id", "title", "published_at") for k, df in tables.items()])


@query("latest_jobs")
def latest_jobs(cat):
    return feeds.first_n(cat.jobs, dashboard.LATEST, feeds.newest_first("created_at")).select("id", "title", "created_at")


@query("first_n")
def first_n(cat):
    blocks = {"tools": (cat.tools, dashboard.FEATURED), "companies": (cat.companies, dashboard.FEATURED),
              "guides": (cat.knowledge_articles, relations.GUIDES)}
    return _union([_kind(k, feeds.first_n(df, n), "id", "slug") for k, (df, n) in blocks.items()])


@query("admin_lists_news")
def admin_lists_news(cat):
    return dashboard.article_list(cat.news_articles, cat.news_categories)


@query("admin_lists_knowledge")
def admin_lists_knowledge(cat):
    return dashboard.article_list(cat.knowledge_articles, cat.knowledge_categories)


@query("admin_lists_jobs")
def admin_lists_jobs(cat):
    return dashboard.job_list(cat.jobs, cat.companies)


@query("admin_lists_companies")
def admin_lists_companies(cat):
    return dashboard.company_list(cat.companies, cat.company_categories)


@query("admin_lists_media")
def admin_lists_media(cat):
    return dashboard.media_list(intake.accepted(intake.check_uploads(cat.media)))


@query("inbox_latest5")
def inbox_latest5(cat):
    return dashboard.inbox_latest(intake.accepted(intake.check_messages(cat.contact_messages)))


# ---------------------------------------------------------------- unions


@query("sitemap")
def sitemap_query(cat):
    return sitemap.sitemap(cat, BASE)


@query("search_all")
def search_all(cat):
    return search.search_all(cat, WORD)


@query("homepage")
def homepage(cat):
    return dashboard.homepage(cat)


# ---------------------------------------------------------------- changes and integrity

ARTICLE_FIELDS = [
    "title", "slug", "summary", "content", "category_id", "featured_image", "status",
    "seo_title", "seo_description", "canonical_url",
]
_STATE = ("id", "title", "slug", "summary", "content", "category_id", "author_id", "status", "published_at", "created_at", "updated_at")


@query("apply_creates")
def apply_creates(cat):
    return changes.apply_creates(cat.news_articles, cat.article_creates).select(*_STATE)


@query("apply_edits")
def apply_edits(cat):
    return changes.apply_edits(cat.news_articles, cat.article_edits, ARTICLE_FIELDS).select(*_STATE, "featured_image", "seo_title")


@query("apply_deletes")
def apply_deletes(cat):
    return changes.apply_deletes(cat.news_articles, cat.article_deletes).select("id", "slug", "status")


def _article_batch(cat) -> DataFrame:
    parts = {"create": cat.article_creates, "edit": cat.article_edits, "delete": cat.article_deletes}
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [df.withColumn("op", F.lit(op)) for op, df in parts.items()],
    )


@query("apply_changes")
def apply_changes(cat):
    """Creates, edits and deletes of articles in one batch."""
    return changes.apply_changes(cat.news_articles, _article_batch(cat), ARTICLE_FIELDS).select(*_STATE)


def stored_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batch applied to stored blocks, twice: the second run changes nothing."""
    cat, root = Catalogue(spark, sf_dir), run_folder(spark, "blocks")
    blocks.write_blocks(cat.news_articles, root, BLOCK_BITS)
    for _ in range(2):
        blocks.apply_batch(spark, root, 1, _article_batch(cat), ARTICLE_FIELDS)
    return blocks.read_blocks(spark, root).select(*_STATE)


QUERIES["stored_changes"] = stored_changes


def maintained_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles per status and category after three mixed batches, by kept counts: no table is counted again."""
    cat, root = Catalogue(spark, sf_dir), run_folder(spark, "blocks")
    blocks.write_blocks(cat.news_articles, root, BLOCK_BITS)
    # Of an id's two edits the later one comes in a later batch.
    part = F.when(F.col("op") == "edit", F.col("change_id") % 2 + 1).otherwise(F.col("id") % 3)
    batch = _article_batch(cat).withColumn("batch", part + 1)
    for number in (1, 2, 3):
        blocks.apply_batch(spark, root, number, batch.where(F.col("batch") == number).drop("batch"), ARTICLE_FIELDS)
    return blocks.stored_counts(spark, root)


QUERIES["maintained_counts"] = maintained_counts


@query("delete_outcomes")
def delete_outcomes(cat):
    return changes.delete_outcomes(cat.knowledge_articles, cat.article_deletes)


def _cascade(cat, **options) -> DataFrame:
    gone = cat.closed_companies
    return _union(
        [
            _kind("companies", changes.apply_deletes(cat.companies, gone), "id"),
            _kind("jobs", changes.remove_children(cat.jobs, "company_id", gone, **options), "id"),
            _kind("services", changes.remove_children(cat.services, "provider_id", gone, **options), "id"),
        ]
    )


@query("cascade_delete")
def cascade_delete(cat):
    return _cascade(cat)


@query("cascade_delete_spread")
def cascade_delete_spread(cat):
    return _cascade(cat, broadcast_bytes=0)


@query("set_null_on_delete")
def set_null_on_delete(cat):
    news = changes.release_children(cat.news_articles, "category_id", cat.closed_categories)
    return changes.release_children(news, "author_id", cat.closed_users).select("id", "category_id", "author_id")


@query("delete_everywhere")
def delete_everywhere(cat):
    """Users, companies and categories deleted, following every foreign key: what is left, and which keys were emptied."""
    tables = {name: getattr(cat, name) for name in TABLES}
    for name, gone in (
        ("companies", cat.closed_companies), ("users", cat.closed_users), ("news_articles", cat.article_deletes),
        ("tool_categories", cat.closed_categories), ("knowledge_categories", cat.closed_categories),
    ):
        tables = changes.delete_rows(tables, name, gone.select(F.col("id").cast("bigint").alias("id")), TABLES)
    keys = {
        "companies": "category_id", "jobs": "company_id", "services": "provider_id", "news_articles": "author_id",
        "knowledge_articles": "category_id", "tools": "category_id", "media": "uploaded_by_id", "news_tags": "news_id", "users": "id",
    }
    return _union([
        tables[name].agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col(key).isNull()).alias("empty"),
            F.coalesce(F.sum(F.col(key).cast("bigint")), F.lit(0)).cast("bigint").alias("key_sum"),
        ).select(F.lit(name).alias("table_name"), "n", "empty", "key_sum")
        for name, key in keys.items()
    ])


@query("apply_creates_jobs")
def apply_creates_jobs(cat):
    """New jobs, one per customer: a job without a status is published, and no publishing moment is kept."""
    creates = cat.companies.selectExpr(
        "id + 100000000000 AS id", "concat('Cutter / no. ', id) AS title", "CAST(NULL AS STRING) AS slug", "description",
        "id AS company_id", "'zone 1' AS location", "CASE WHEN id % 2 = 0 THEN 'draft' END AS status", "created_at AS changed_at",
    )
    grown = changes.apply_creates(cat.jobs, creates, changes.LISTING_DEFAULT)
    return grown.select("id", "title", "slug", "company_id", "location", "status", "created_at")


@query("apply_edits_companies")
def apply_edits_companies(cat):
    """Two edits per supplier's company; a missing status means published."""
    edits = cat.users.selectExpr(
        "id", "explode(array(1, 2)) AS turn", "username"
    ).selectExpr(
        "id * 2 + turn AS change_id", "id", "timestampadd(MINUTE, turn, TIMESTAMP_NTZ'2024-06-01 00:00:00') AS changed_at",
        "concat(username, ' & Co ', turn) AS name", "'' AS slug", "CASE WHEN turn = 1 THEN 'draft' END AS status",
        "CAST(id % 25 AS STRING) AS category_id",
    )
    fields = ["name", "slug", "status", "category_id"]
    edited = changes.apply_edits(cat.companies, edits, fields, changes.LISTING_DEFAULT, "name")
    return edited.select("id", "name", "slug", "status", "category_id", "description")


@query("change_outcomes")
def change_outcomes(cat):
    """Why new articles are taken or refused: missing texts, ids and slugs that are taken already."""
    creates = cat.article_creates.selectExpr(
        "CASE WHEN id % 5 = 0 THEN id - 100000000000 ELSE id END AS id", "changed_at", "title",
        "CASE id % 7 WHEN 1 THEN 'doc-3' WHEN 2 THEN 'twice' ELSE slug END AS slug", "CASE WHEN id % 11 = 0 THEN '' ELSE summary END AS summary",
        "content", "category_id", "status",
    )
    return changes.create_outcomes(cat.news_articles, creates, ["title", "summary", "content"]).select("id", "slug", "outcome")


@query("violations_all")
def violations_all(cat):
    """Every declared rule over all tables."""
    return integrity.check_tables({name: getattr(cat, name) for name in TABLES}, TABLES)


@query("violations_on_write")
def violations_on_write(cat):
    """Every table stored, with the number of rows that break each row rule, counted while they are written."""
    root = run_folder(cat.spark, "checked")
    return _union([write_checked(getattr(cat, name), root, name) for name in TABLES])


@query("violations_unique")
def violations_unique(cat):
    return integrity.duplicates(cat.news_articles, "news_articles", ["content"], digest=True).unionByName(
        integrity.duplicates(cat.styles, "styles", ["group_id", "stitch_class"])
    ).unionByName(integrity.duplicates(cat.tools, "tools", ["name"]))


@query("violations_not_null")
def violations_not_null(cat):
    columns = ["name", "email", "subject", "message", "created_at"]
    return integrity.missing_values(cat.contact_messages, "contact_messages", columns).unionByName(
        integrity.missing_values(cat.news_articles, "news_articles", ["title", "category_id", "published_at"])
    )


@query("violations_foreign_key")
def violations_foreign_key(cat):
    return integrity.orphans(cat.news_articles, "news_articles", "author_id", cat.users).unionByName(
        integrity.orphans(cat.jobs, "jobs", "company_id", cat.services)
    )


@query("violations_length")
def violations_length(cat):
    return integrity.too_long(cat.news_articles, "news_articles", {"title": TITLE_LIMIT, "slug": SLUG_LIMIT}).unionByName(
        integrity.too_long(cat.jobs, "jobs", {"title": 15, "location": 5})
    )


@query("violations_domain")
def violations_domain(cat):
    return integrity.outside_domain(cat.news_articles, "news_articles", {"status": LISTING_STATUSES}).unionByName(
        integrity.outside_domain(cat.jobs, "jobs", {"status": ALLOWED_STATUSES, "job_type": JOB_TYPES[:2]})
    )


# ---------------------------------------------------------------- expressions of their own


@query("item_slugs")
def item_slugs(cat):
    return cat.news_articles.select("id", slug_of(F.col("content")).alias("made"), slug_of(F.col("content"), F.col("seo_title")).alias("kept"))


@query("browser_numbers")
def browser_numbers(cat):
    """Numbers at the start of texts, and decimal texts of event values."""
    tail = F.regexp_extract("message", ": *(.*)$", 1)
    events = cat.contact_messages.select("id", tail.alias("tail"))
    return events.select(
        "id",
        read_number(F.col("tail")).alias("number"),
        read_whole(F.col("tail")).alias("whole"),
        read_number(F.lit("x")).alias("none"),
        fixed_text(read_number(F.col("tail")) / 8, 2).alias("eighths"),
        fixed_text(-read_number(F.col("tail")) / 1000, 1).alias("thousandths"),
    )


# ---------------------------------------------------------------- routing


@query("intent_routing")
def intent_routing(cat):
    return routing.route(cat.questions, ROUTES).select("conv_id", "turn", "intent")


@query("intent_summary")
def intent_summary(cat):
    return routing.intent_summary(cat.questions, ROUTES)


# ---------------------------------------------------------------- costing


def _sheet(build, numbers: tuple[str, ...], texts: tuple[str, ...]):
    def run(cat):
        sheet = build(cat.styles)
        return sheet.select(
            "style_id", "group_id", costing.REASON, *[F.round(n, 6).alias(n) for n in numbers], *texts
        )

    return run


query("costing_sam")(_sheet(costing.sam_sheet, ("sam", "target_per_hour"), ("infinite_target", "sam_text", "target_text")))
query("costing_gsm")(_sheet(costing.gsm_sheet, ("area_cm2", "gsm_value"), ("gsm_class", "gsm_text", "area_text")))
query("costing_thread")(
    _sheet(costing.thread_sheet, ("factor", "raw_thread", "total_thread"), ("factor_text", "raw_thread_text", "thread_text"))
)
query("costing_fabric_weight")(
    _sheet(costing.fabric_weight_sheet, ("raw_weight", "total_weight", "dozen_kg"), ("raw_weight_text", "weight_text", "dozen_text"))
)
query("costing_fabric_price")(
    _sheet(costing.fabric_price_sheet, ("raw_price", "fabric_price", "loss_price"), ("raw_price_text", "loss_text", "fabric_price_text"))
)
query("costing_cm")(
    _sheet(costing.cm_sheet, ("day_cost", "expected_output", "cm_cost"), ("day_text", "output_text", "cm_text"))
)


@query("costing_fob")
def costing_fob(cat):
    inputs = cat.styles.withColumns({"fabric": F.col("yarn"), "cm": F.col("dye")})
    return costing.fob_sheet(inputs).select(
        "style_id", "group_id", costing.REASON, *[F.round(n, 6).alias(n) for n in ("base_cost", "fob", "profit")],
        "base_text", "profit_text", "fob_text",
    )


@query("costing_sheet")
def costing_sheet(cat):
    return costing.cost_sheet(cat.styles)


# ---------------------------------------------------------------- streaming


def _taken_in(spark: SparkSession, sf_dir: str, inbox: bool) -> str:
    """Run the intake over the event files; returns the store."""
    # As a pattern the path may be one file or a folder of files.
    reader = spark.readStream.schema(RAW_COLUMNS["events"]).option("maxFilesPerTrigger", contact.BATCH_FILES)
    files = reader.parquet(f"{sf_dir}/events.parquet*")
    stream = from_events(files)
    folder = run_folder(spark, "intake")
    contact.start_intake(stream, f"{folder}/store", f"{folder}/checkpoint", inbox).awaitTermination()
    return f"{folder}/store"


def contact_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _taken_in(spark, sf_dir, inbox=False)
    return contact.stored_messages(spark, store).drop("run", "batch", "outcome")


def contact_intake_without_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as the form sends them, without id and time and many of them equal: all are kept, once each."""
    reader = spark.readStream.schema(RAW_COLUMNS["events"]).option("maxFilesPerTrigger", contact.BATCH_FILES)
    files = contact.with_file_ids(reader.parquet(f"{sf_dir}/events.parquet*"))
    stream = files.selectExpr(
        "id", "CASE user_id % 19 WHEN 0 THEN '' ELSE concat('user-', user_id % 7) END AS name", "'u@example.org' AS email",
        "event_type AS subject", "event_type AS message",
    )
    folder = run_folder(spark, "intake")
    contact.start_intake(stream, f"{folder}/store", f"{folder}/checkpoint", False).awaitTermination()
    return contact.stored_messages(spark, f"{folder}/store").drop("id", "created_at", "run", "batch", "outcome")


def inbox_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contact.latest_messages(spark, _taken_in(spark, sf_dir, inbox=True))


QUERIES["contact_intake"] = contact_intake
QUERIES["contact_intake_without_ids"] = contact_intake_without_ids
QUERIES["inbox_stream"] = inbox_stream
