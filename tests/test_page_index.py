"""The page index against a plain sort."""

import datetime as dt
import random

import pytest

from weftbook.operators import feeds, pageindex
from weftbook.operators.pageindex import PageIndex

DAY = dt.datetime(2024, 1, 1)


def feed(spark, n, kind="mixed"):
    pick = random.Random(n)
    moment = {
        "mixed": lambda i: None if i % 5 == 0 else DAY if i % 3 == 0 else DAY + dt.timedelta(minutes=pick.randrange(40)),
        "undated": lambda i: None,
        "one day": lambda i: DAY,
        "dates": lambda i: DAY + dt.timedelta(seconds=i * 7919 % 10007),
    }[kind]
    rows = [(i * 3 - n, moment(i), f"t{i}") for i in range(n)]
    pick.shuffle(rows)
    return spark.createDataFrame(rows, "id long, published_at timestamp_ntz, title string").repartition(3)


def sorted_ids(items):
    return [r.id for r in items.orderBy(*feeds.newest_first("published_at")).collect()]


@pytest.mark.parametrize("kind", ["mixed", "undated", "one day", "dates"])
def test_all_pages_in_order(spark, kind):
    items = feed(spark, 600, kind)
    index = PageIndex.build(items, "published_at", 20)
    assert index.total == 600 and index.page_count() == 60
    assert max(index.sizes) <= 60 and len(index.borders) >= 15  # ties and rows without a date are cut by id
    found = index.all_pages().orderBy("position").collect()
    assert [r.id for r in found] == sorted_ids(items)
    assert [(r.position, r.page_no) for r in found] == [(p, (p - 1) // 10 + 1) for p in range(1, 601)]


@pytest.mark.parametrize("kind", ["mixed", "dates"])
def test_pages_of_a_kept_index(spark, tmp_path, kind):
    items = feed(spark, 203, kind)
    whole = sorted_ids(items)
    PageIndex.build(items, "published_at", 16).save(str(tmp_path / "x"))
    index = PageIndex.load(items, "published_at", str(tmp_path / "x"), 16)
    for page in (1, 2, 5, 13, 20, 21, 22, "x", 0):
        at = (page - 1) * 10 if page in range(1, 23) else 0
        assert [r.id for r in index.page(page).collect()] == whole[at : at + 10], page
    assert [r.id for r in index.slice(37, 90).collect()] == whole[37:127]


def test_large_ranges_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(pageindex, "MAX_RANGES", 3)
    items = feed(spark, 400)
    whole, built, build = sorted_ids(items), [], PageIndex.build
    index = build(items, "published_at", 8)
    monkeypatch.setattr(PageIndex, "build", lambda *a: built.append(a) or build(*a))
    for page in (1, 9, 24, 40):
        assert [r.id for r in index.page(page).collect()] == whole[(page - 1) * 10 : page * 10]
    assert built


@pytest.mark.parametrize("n", [0, 1])
def test_small_feeds(spark, n):
    index = PageIndex.build(feed(spark, n), "published_at", 20)
    assert index.borders == [] and index.total == n
    assert index.page(1).count() == index.all_pages().count() == n and index.page(2).count() == 0


def test_bounds_reach_the_files(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    items = feed(spark, 500, "dates").sort("published_at")
    items.write.parquet(str(tmp_path / "feed"))
    stored = spark.read.parquet(str(tmp_path / "feed"))
    page = PageIndex.build(stored, "published_at", 50).page(30)
    plan = page._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1]
    assert "GreaterThanOrEqual(published_at" in pushed and "LessThanOrEqual(published_at" in pushed
    whole = PageIndex.build(stored, "published_at", 50).all_pages()
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning" in plan
