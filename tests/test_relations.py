"""Joins, related items and pages against brute force on small skewed data."""

import random

import pytest
from pyspark.sql import functions as F

from weftbook.operators import feeds, paging, relations
from weftbook.operators.lookup import lookup_few, lookup_join, present_keys, unique_join


def skewed(spark, rows=600):
    """Key 1 holds a third of the rows, another part has no key or an unknown one."""
    rng = random.Random(7)
    data = [(i, 1 if i % 3 == 0 else rng.choice([None, 2, 3, 4, 5, 6, 7, 99])) for i in range(rows)]
    left = spark.createDataFrame(data, "id bigint, k bigint")
    right = spark.createDataFrame([(k, f"name {k}") for k in range(1, 8)], "k bigint, name string")
    return data, left, right


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("limit", [None, 0])
def test_lookup_with_hot_and_missing_keys(spark, how, limit):
    data, left, right = skewed(spark)
    names = {k: f"name {k}" for k in range(1, 8)}
    found = lookup_join(left, right, ["k"], how, broadcast_bytes=limit).collect()
    wanted = {
        "left": {(i, names.get(k)) for i, k in data},
        "inner": {(i, names[k]) for i, k in data if k in names},
        "left_semi": {(i, None) for i, k in data if k in names},
        "left_anti": {(i, None) for i, k in data if k not in names},
    }[how]
    assert {(r.id, r.name if "name" in r else None) for r in found} == wanted and len(found) == len(wanted)


def test_lookup_on_two_keys(spark):
    _, left, right = skewed(spark)
    left, right = left.withColumn("b", F.col("id") % 2), right.withColumn("b", F.lit(1).cast("bigint"))
    large = lookup_join(left, right, ["k", "b"], "left", broadcast_bytes=0)
    plain = left.join(right, ["k", "b"], "left")
    assert sorted(map(str, large.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_a_large_lookup_reads_each_side_once(cat):
    plan = feeds.jobs_with_company(cat.jobs, cat.companies, broadcast_bytes=0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("orders.parquet") == 1 and plan.count("customer.parquet") == 1 and "SortMergeJoin" in plan
    tagged = relations.article_tags(cat.news_articles, cat.news_tags, "news_id", cat.tags)
    assert tagged._jdf.queryExecution().executedPlan().toString().count("documents.parquet") <= 4


def test_skewed_partitions_are_split(spark):
    """A third of the rows without a key, a third with one: the final plan reads the left side in several parts."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        left = spark.range(0, 60000, 1, 8).selectExpr("id", "CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE id END AS k")
        right = spark.range(1, 60000).selectExpr("id AS k", "concat('n', id) AS name")
        joined = lookup_join(left, right, ["k"], broadcast_bytes=0)
        assert joined.where("name IS NULL").count() == 20000
        joined.write.format("noop").mode("overwrite").save()
        whole = lookup_join(left, right, ["k"], broadcast_bytes=0)
        whole.collect()
        assert "skew" in whole._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_lookup_few_in_both_ways(spark):
    _, left, right = skewed(spark)
    few = left.orderBy("id").limit(8)
    small = {(r.id, r.name) for r in lookup_few(few, right, ["k"]).collect()}
    large = {(r.id, r.name) for r in lookup_few(few, right, ["k"], broadcast_bytes=0).collect()}
    assert small == large and len(small) == 8


@pytest.mark.parametrize("limit", [0, 10**30])
def test_unique_joins_in_both_ways(spark, limit):
    left, right = spark.range(20), spark.range(10, 30)
    for how, size in (("left", 20), ("inner", 10), ("left_anti", 10)):
        assert unique_join(left, right, ["id"], how, broadcast_bytes=limit).count() == size
    table = spark.range(100).selectExpr("id % 15 AS id")
    assert sorted(r.id for r in present_keys(right, table, "id", broadcast_bytes=limit).collect()) == [10, 11, 12, 13, 14]


def related_by_hand(data, n=3):
    out = set()
    for i, group in data:
        others = sorted(j for j, other in data if other == group and j != i)[:n]
        out |= {(i, rank, j) for rank, j in enumerate(others, 1)}
    return out


@pytest.mark.parametrize("limit", [None, 0])
def test_related_items(spark, limit):
    data = [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, None), (7, None), (8, 2)]
    rows = [(i, f"t{i}", f"s{i}", g, "published") for i, g in data] + [(0, "t0", "s0", 1, "draft")]
    items = spark.createDataFrame(rows, "id bigint, title string, slug string, category_id bigint, status string")
    options = {} if limit is None else {"broadcast_bytes": limit}
    found = relations.related_items(items, "category_id", "title", **options).collect()
    assert {(r.id, r.rank, r.related_id) for r in found} == related_by_hand(data)


def test_related_items_of_a_large_group(spark):
    data = [(i, 1 if i % 3 else i) for i in range(300)]
    rows = [(i, f"t{i}", f"s{i}", g, "published") for i, g in data]
    items = spark.createDataFrame(rows, "id bigint, title string, slug string, category_id bigint, status string")
    found = relations.related_items(items, "category_id", "title", broadcast_bytes=0).collect()
    assert {(r.id, r.rank, r.related_id) for r in found} == related_by_hand(data)


def test_related_items_cut_groups_before_the_shuffle(cat):
    plan = relations.related_items(cat.jobs, "company_id", "title")._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 4, Partial" in plan


def dated(spark, n):
    moment = "make_timestamp_ntz(2024, 1, CAST(1 + id % 5 AS INT), 0, 0, 0)"
    return spark.range(n).selectExpr("id", f"CASE WHEN id % 3 = 0 THEN NULL ELSE {moment} END AS published_at")


def test_nulls_come_first(spark):
    order = feeds.newest_first("published_at")
    days = [r.published_at for r in dated(spark, 6).orderBy(*order).collect()]
    assert days[:2] == [None, None] and days[2:] == sorted(days[2:], reverse=True)


def test_pages_of_a_feed(spark):
    order, items = [F.col("id")], spark.range(21)
    page = lambda p: [r.id for r in paging.page_of(items, order, p).collect()]
    assert page(0) == page(1) == page("x") == page(None) == list(range(10))
    assert page(3) == [20]
    assert page("4") == []


def test_deep_pages_are_the_same_pages(spark):
    order, items = [F.desc("id")], spark.range(35).repartition(4)
    for p in (1, 3, 4, 9):
        near = [r.id for r in paging.page_of(items, order, p).collect()]
        assert sorted(r.id for r in paging.page_of(items, order, p, deep=0).collect()) == sorted(near)


def test_page_counts(spark):
    frames = {n: spark.range(n).withColumn("status", F.lit("published")) for n in (0, 10, 21)}
    found = {r.feed: (r.total, r.pages) for r in paging.page_counts({str(n): df for n, df in frames.items()}).collect()}
    assert found == {"0": (0, 0), "10": (10, 1), "21": (21, 3)}


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_all_pages_number_every_row_once(spark, n):
    order = feeds.newest_first("published_at")
    items = dated(spark, n).repartition(7)
    found = paging.all_pages(items, order).orderBy("position").collect()
    expected = [r.id for r in items.orderBy(*order).collect()]
    assert [r.id for r in found] == expected
    assert [r.position for r in found] == list(range(1, n + 1))
    assert [r.page_no for r in found] == [(p - 1) // 10 + 1 for p in range(1, n + 1)]


def test_childless_parents_stay(spark):
    parents = spark.range(3)
    children = spark.createDataFrame([(10, 0), (11, 0), (12, None), (13, 9)], "id bigint, p bigint")
    rows = {(r.parent_id, r.child_id) for r in relations.children_of(parents, children, "p", "x").collect()}
    assert rows == {(0, 10), (0, 11), (1, None), (2, None)}
    counts = {(r.parent_id, r.children) for r in relations.children_counts(parents, children, "p", "x").collect()}
    assert counts == {(0, 2), (1, 0), (2, 0)}


def test_company_profile_spread(cat):
    args = (cat.companies, cat.jobs, cat.services)
    plain = relations.company_profiles(*args)
    spread = relations.company_profiles(*args, broadcast_bytes=0)
    assert sorted(map(str, plain.collect())) == sorted(map(str, spread.select(*plain.columns).collect()))


def test_tool_page_has_related_tools_and_guides(cat):
    first = relations.tool_pages(cat.tools, cat.knowledge_articles).orderBy("id").first()
    assert len(first.guides) == 2 and 1 <= len(first.related) <= 3
    assert first.id not in [r.id for r in first.related]


def test_slug_lookup_tells_what_is_missing(spark):
    items = spark.createDataFrame([(1, "a", "published"), (2, "b", "draft")], "id bigint, slug string, status string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "slug string")
    for limit in (0, 10**6):
        found = sorted((r.slug, r.found) for r in feeds.find_by_slug(asked, items, broadcast_bytes=limit).collect())
        assert found == [("a", True), ("a", True), ("b", False), ("c", False)]


def test_pages_and_feeds_come_in_order(spark, cat):
    order = feeds.newest_first("published_at")
    items = dated(spark, 95).repartition(7)
    whole = [r.id for r in items.orderBy(*order).collect()]
    for page in (1, 3, 10):
        for deep in (0, paging.DEEP_ROWS):
            assert [r.id for r in paging.page_of(items, order, page, deep=deep).collect()] == whole[(page - 1) * 10 : page * 10]
    rows = feeds.published(cat.jobs).select("id", "created_at").collect()
    rows.sort(key=lambda r: r.id)
    rows.sort(key=lambda r: (r.created_at is not None, -r.created_at.timestamp() if r.created_at else 0))
    assert [r.id for r in feeds.job_feed(cat.jobs, cat.companies).collect()] == [r.id for r in rows]
