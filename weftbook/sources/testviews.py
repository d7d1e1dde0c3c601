"""The driver's test tables seen as the tables of the catalogue.

Every view takes a whole table.  Dates come from ids, never from the clock; NULLs,
empty texts, every status and published rows without a date occur on purpose.  The test tables
have no titles and summaries, so these are made from other columns; ``content`` is the whole text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _minutes(n: str) -> str:
    """SQL text of the moment ``n`` minutes after the start of 2024."""
    return f"timestampadd(MINUTE, CAST({n} AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00')"


# Columns of the driver's tables (fixed values); declared, so that no file is opened to plan.
RAW_COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(RAW_COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _article_columns(key: str) -> list[str]:
    """Columns of an article that follow from its id alone."""
    return [
        f"CASE WHEN {key} % 4 = 0 THEN NULL ELSE concat('/img/', {key}, '.png') END AS featured_image",
        f"CASE WHEN {key} % 11 = 0 THEN NULL ELSE {key} % 5 END AS category_id",
        f"CASE WHEN {key} % 13 = 0 THEN NULL ELSE {key} % 120 END AS author_id",
        f"CASE {key} % 7 WHEN 0 THEN 'draft' WHEN 1 THEN 'review' WHEN 2 THEN 'archived' ELSE 'published' END AS status",
        f"CASE WHEN {key} % 7 < 3 OR {key} % 17 = 0 THEN NULL ELSE {_minutes(f'({key} * 7919) % 100003')} END"
        " AS published_at",
        f"{_minutes(f'{key} % 1000003')} AS created_at",
        f"{_minutes(f'{key} % 1000003 + 60')} AS updated_at",
        f"CASE {key} % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('seo ', {key}) END AS seo_title",
        f"CASE {key} % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('about ', {key}) END AS seo_description",
        "CAST(NULL AS STRING) AS canonical_url",
    ]


def news_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "documents").selectExpr(
        "doc_id AS id",
        "concat('Piece ', doc_id, ' of ', source, ' in ', lang, ', the ', n_chars, ' characters') AS title",
        "concat('doc-', doc_id) AS slug",
        "concat('A text of ', n_chars, ' characters in the language ', lang, ', taken from the source ', source, ' and kept under',"
        " ' the number ', doc_id, '; it is shown with its category, its author and tags, and with the day on which it came out')"
        " AS summary",
        "text AS content",
        *_article_columns("doc_id"),
    )


def knowledge_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "pages").selectExpr(
        "page_id AS id",
        "url AS title",
        "concat('page-', page_id) AS slug",
        "concat('Page at ', url) AS summary",
        "html AS content",
        *_article_columns("page_id"),
    )


def _region_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "region").selectExpr(
        "r_regionkey AS id", "r_name AS name", "lower(replace(r_name, ' ', '-')) AS slug"
    )


def company_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "nation").selectExpr("n_nationkey AS id", "n_name AS name", "lower(n_name) AS slug")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS id",
        "s_name AS username",
        "concat('u', s_suppkey, '@example.org') AS email",
        "s_acctbal >= 0 AS is_active",
    )


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "nation").selectExpr("n_nationkey AS id", "lower(n_name) AS name", "lower(n_name) AS slug")


def _bridge(df: DataFrame, key: str, owner: str) -> DataFrame:
    first = df.selectExpr(f"{key} AS {owner}", f"{key} % 25 AS tag_id")
    second = df.selectExpr(f"{key} AS {owner}", f"({key} * 3 + 1) % 25 AS tag_id")
    return first.unionByName(second.where(f"({owner} * 3 + 1) % 25 <> {owner} % 25"))


def news_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bridge(raw(spark, sf_dir, "documents"), "doc_id", "news_id")


def knowledge_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bridge(raw(spark, sf_dir, "pages"), "page_id", "knowledge_id")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id",
        "c_name AS name",
        "concat('c-', c_custkey) AS slug",
        "concat(c_name, ' of the ', lower(c_mktsegment), ' trade, listed with all of its open jobs and services;'"
        ", ' balance ', CAST(CAST(c_acctbal AS INT) AS STRING), ' in the directory of makers,'"
        ", ' traders and service houses of this district and its neighbours') AS description",
        "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('/logo/', c_custkey, '.png') END AS logo",
        "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_nationkey END AS category_id",
        "concat('https://c', c_custkey, '.example.org') AS website",
        "concat('c', c_custkey, '@example.org') AS email",
        "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('+00-', c_custkey) END AS phone",
        "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS address",
        "CASE c_custkey % 6 WHEN 0 THEN 'draft' WHEN 1 THEN 'archived' ELSE 'published' END AS status",
        f"{_minutes('(c_custkey * 37) % 10007')} AS created_at",
        "CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('seo ', c_custkey) END AS seo_title",
        "CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('about ', c_custkey) END AS seo_description",
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id",
        "concat(o_orderpriority, ' ', o_orderkey) AS title",
        "concat('job-', o_orderkey) AS slug",
        "o_orderpriority AS description",
        "o_custkey AS company_id",
        "concat('zone ', o_orderkey % 9) AS location",
        "CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('up to ', o_orderkey % 90) END AS salary_range",
        "CASE o_orderkey % 4 WHEN 0 THEN 'Full-time' WHEN 1 THEN 'Part-time' WHEN 2 THEN 'Contract'"
        " ELSE 'Internship' END AS job_type",
        "CASE o_orderstatus WHEN 'O' THEN 'published' WHEN 'F' THEN 'archived' ELSE 'draft' END AS status",
        "o_orderdate AS created_at",
        "CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('seo ', o_orderkey) END AS seo_title",
        "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('about ', o_orderkey) END AS seo_description",
    )


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS id",
        "s_name AS name",
        "concat('s-', s_suppkey) AS slug",
        "concat(s_name, ' service') AS description",
        "s_suppkey AS provider_id",
        "CASE WHEN s_suppkey % 5 = 0 THEN 'draft' ELSE 'published' END AS status",
    )


def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id",
        "p_name AS name",
        "concat('t-', p_partkey) AS slug",
        "concat(p_type, ' ', p_brand) AS description",
        "CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_partkey % 5 END AS category_id",
        "CASE WHEN p_partkey % 6 = 0 THEN 'draft' ELSE 'published' END AS status",
    )


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads: each page's bytes behind the first bytes of some file kind."""
    header = (
        "unhex(CASE page_id % 6 WHEN 0 THEN '89504E470D0A1A0A0000000D' WHEN 1 THEN 'FFD8FFE000104A4649460001'"
        " WHEN 2 THEN '474946383961010001008000' WHEN 3 THEN '524946462400000057454250'"
        " WHEN 4 THEN '524946462400000057415645' ELSE '3C21444F4354595045206874' END)"
    )
    return raw(spark, sf_dir, "pages").selectExpr(
        "page_id AS id",
        "CASE page_id % 23 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE url END AS filename",
        f"{header} AS header",
        "CAST(CASE page_id % 9 WHEN 0 THEN 5242880 WHEN 1 THEN 5242881 ELSE octet_length(html) + 12 END AS BIGINT)"
        " AS file_size",
        "CASE WHEN page_id % 13 = 0 THEN NULL ELSE page_id % 120 END AS uploaded_by_id",
        f"{_minutes('(page_id * 31) % 5003')} AS created_at",
    )


def contact_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as they arrive; some lack a required text."""
    return from_events(raw(spark, sf_dir, "events"))


def from_events(events: DataFrame) -> DataFrame:
    """Also applied to the stream of event files."""
    return events.selectExpr(
        "event_id AS id",
        "CASE event_id % 19 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('user-', user_id) END AS name",
        "concat('u', user_id, '@example.org') AS email",
        "event_type AS subject",
        "props AS message",
        "ts AS created_at",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "conversations").where(F.col("role") == "user").select("conv_id", "turn", "text")


def styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of the seven cost sheets; the group is the order."""
    return raw(spark, sf_dir, "lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT)) AS style_id",
        "l_orderkey AS group_id",
        "(l_quantity - 1) / 2 AS smv",
        "CASE WHEN l_linenumber = 7 THEN -100.0D ELSE l_linenumber * 5.0D END AS allowance",
        "CASE WHEN l_linenumber = 1 THEN 0.0D ELSE 60.0D + l_quantity * 2 END AS efficiency",
        "CASE WHEN l_linenumber = 1 THEN 0.0D ELSE 60.0D + l_quantity * 2 END AS line_efficiency",
        "l_quantity / 10 AS swatch_weight",
        "CASE WHEN l_linenumber % 2 = 0 THEN 'rectangular' ELSE 'circular' END AS swatch_type",
        "CAST(l_linenumber * 5 AS DOUBLE) AS swatch_length",
        "CAST(10 AS DOUBLE) AS swatch_width",
        "(l_quantity - 1) / 4 AS seam_length",
        "CASE l_linenumber % 3 WHEN 0 THEN '301' WHEN 1 THEN '401' ELSE '504' END AS stitch_class",
        "40.0D + l_linenumber AS chest",
        "60.0D + l_linenumber AS body_length",
        "140.0D + l_quantity * 3 AS gsm",
        "l_discount * 1000 AS wastage",
        "l_discount * 600 AS fabric_wastage",
        "3.0D + l_tax AS yarn",
        "0.5D AS knit",
        "l_tax * 10 AS dye",
        "CAST(l_linenumber * 4 AS DOUBLE) AS operators",
        "12.0D AS wage",
        "l_quantity * 10 AS overhead",
        "l_quantity * 20 AS target",
        "l_tax * 1000 AS trims",
        "l_discount AS accessories",
        "0.4D AS logistics",
        "l_discount * 3000 - 60 AS margin",
    )


def article_creates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New articles, one per benchmark passage."""
    return raw(spark, sf_dir, "benchmark").selectExpr(
        "item_id + 100000000000 AS id",
        f"{_minutes('item_id % 1000003')} AS changed_at",
        "concat('Entry Ñ', item_id, ' / of the set') AS title",
        "CASE item_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('Item ', item_id, '/New') END AS slug",
        "concat('Passage ', item_id, ' as it was sent in') AS summary",
        "text AS content",
        "CASE WHEN item_id % 4 = 0 THEN '' ELSE CAST(item_id % 5 AS STRING) END AS category_id",
        "item_id % 120 AS author_id",
        "CASE item_id % 3 WHEN 0 THEN 'published' WHEN 1 THEN NULL ELSE 'review' END AS status",
    )


def article_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edits for every labelled document: one by quality, a later one by toxicity."""
    labels = raw(spark, sf_dir, "labels")
    first = labels.selectExpr(
        "doc_id * 2 AS change_id",
        "doc_id AS id",
        f"{_minutes('200000 + doc_id % 1000003')} AS changed_at",
        "concat('checked ', doc_id) AS title",
        "concat('doc-', doc_id) AS slug",
        "'checked' AS summary",
        "'checked text' AS content",
        "'1' AS category_id",
        "CASE quality WHEN 1 THEN 'published' ELSE 'draft' END AS status",
    )
    second = labels.selectExpr(
        "doc_id * 2 + 1 AS change_id",
        "doc_id AS id",
        f"{_minutes('300000 + doc_id % 1000003')} AS changed_at",
        "concat('Final ', doc_id) AS title",
        "CASE toxic WHEN 1 THEN '' ELSE concat('Doc ', doc_id) END AS slug",
        "CASE toxic WHEN 1 THEN NULL ELSE 'final' END AS summary",
        "'final text' AS content",
        "'' AS category_id",
        "CASE toxic WHEN 1 THEN 'archived' ELSE 'published' END AS status",
    )
    return first.unionByName(second)


def article_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete requests: one per stored vector."""
    return raw(spark, sf_dir, "embeddings").selectExpr("vec_id AS id")


def closed_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies to delete: accounts in debit."""
    return raw(spark, sf_dir, "customer").where("c_acctbal < 0").selectExpr("c_custkey AS id")


def closed_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "supplier").where("s_acctbal < 0").selectExpr("s_suppkey AS id")


def closed_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories to delete: those whose name starts with A."""
    return raw(spark, sf_dir, "region").where("r_name LIKE 'A%'").selectExpr("r_regionkey AS id")


VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "users": users,
    "tags": tags,
    "news_tags": news_tags,
    "knowledge_tags": knowledge_tags,
    "news_categories": _region_categories,
    "knowledge_categories": _region_categories,
    "company_categories": company_categories,
    "tool_categories": _region_categories,
    "news_articles": news_articles,
    "knowledge_articles": knowledge_articles,
    "companies": companies,
    "jobs": jobs,
    "services": services,
    "tools": tools,
    "media": media,
    "contact_messages": contact_messages,
}


# Inputs that are not tables of the catalogue.
INPUTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "questions": questions,
    "styles": styles,
    "article_creates": article_creates,
    "article_edits": article_edits,
    "article_deletes": article_deletes,
    "closed_companies": closed_companies,
    "closed_users": closed_users,
    "closed_categories": closed_categories,
}


class Catalogue:
    """The views of one data folder, opened on first use: ``Catalogue(spark, dir).jobs``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        view = VIEWS.get(name) or INPUTS.get(name)
        if view is None:
            raise AttributeError(name)
        frame = view(self.spark, self.sf_dir)
        setattr(self, name, frame)
        return frame
