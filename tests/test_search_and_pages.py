"""Search wildcards, routing words, page texts and structured records on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from weftbook.operators import dashboard, pages, routing, search


@pytest.fixture(scope="module")
def tools(spark):
    names = ["50 percent", "50% off", "abc", "a_c", "Axc", "back\\slash", None]
    rows = [(i, n, f"s{i}", None, "published") for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "id bigint, name string, slug string, description string, status string")


@pytest.mark.parametrize(
    "query, ids",
    [
        ("  ", []),
        ("50%", [0, 1]),
        ("50\\%", [1]),
        ("a_c", [2, 3, 4]),
        ("a\\_c", [3]),
        ("AB", [2]),
        ("k\\s", [5]),
        ("k\\\\s", [5]),
    ],
)
def test_keyword_search(tools, query, ids):
    assert [r.id for r in search.keyword_search("tools", tools, query).orderBy("id").collect()] == ids


def test_search_stops_at_ten(spark):
    rows = spark.range(30).selectExpr("id", "'x' AS name", "'s' AS slug", "'y' AS description", "'published' AS status")
    assert [r.id for r in search.keyword_search("tools", rows, "X").collect()] == list(range(10))


def test_search_becomes_a_contains(cat):
    plan = search.matches(cat.news_articles, ("content",), "the")._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(lower(" in plan


def test_totals_count_after_the_cap(cat):
    totals = {r.section: r.hits for r in search.search_totals(cat, "e").collect()}
    assert totals["all"] == sum(v for k, v in totals.items() if k != "all")
    assert max(v for k, v in totals.items() if k != "all") == 10


@pytest.mark.parametrize(
    "text, intent",
    [
        ("What is the SAM of a polo?", "benchmark"),
        ("the same cost", "benchmark"),
        ("CM please", "costing"),
        ("fob of a hoodie", "costing"),
        ("single jersey", "fabric"),
        ("hello", "fallback"),
        (" \n \t", None),
        ("", None),
    ],
)
def test_intents(spark, text, intent):
    found = routing.route(spark.createDataFrame([(text,)], "text string")).collect()
    assert [r.intent for r in found] == ([] if intent is None else [intent])


def test_summary_counts(spark):
    rows = spark.createDataFrame([("sam",), ("smv",), ("x",), (" ",)], "text string")
    assert {(r.intent, r.questions) for r in routing.intent_summary(rows).collect()} == {("benchmark", 2), ("fallback", 1)}


def test_metadata_prefers_own_texts(spark):
    rows = [(1, "T", "D" * 200, None, "", "published"), (2, "T", "D", "S", "E", "published"), (3, "T", "D", "S", "E", "draft")]
    jobs = spark.createDataFrame(
        rows, "id bigint, title string, description string, seo_title string, seo_description string, status string"
    )
    found = {r.id: (r.page_title, r.meta_description) for r in pages.page_metadata("jobs", jobs, place="X").collect()}
    assert found == {1: ("T — Garment Jobs X", "D" * 150), 2: ("S — Garment Jobs X", "E")}


def test_structured_record_is_valid_json(spark):
    df = spark.sql(
        "SELECT 1L AS id, 'say \"hi\"\n' AS title, 's' AS summary, CAST(NULL AS TIMESTAMP_NTZ) AS published_at,"
        " TIMESTAMP_NTZ'2024-01-02 00:00:00' AS updated_at, CAST(NULL AS BIGINT) AS author_id, 'published' AS status"
    )
    users = spark.createDataFrame([(1, "u")], "id bigint, username string")
    record = json.loads(pages.structured_data("news", df, users, "Site").first().record)
    assert record["headline"] == 'say "hi"\n'
    assert record["datePublished"] == "" and record["dateModified"] == "2024-01-02T00:00:00"
    assert record["author"] == {"@type": "Person", "name": "Site Editor"}


def test_inbox_shows_newest(spark):
    rows = spark.range(9).selectExpr(
        "id", "make_timestamp_ntz(2024, 1, CAST(id + 1 AS INT), 1, 2, 0) AS created_at", "'n' AS name", "'e' AS email",
        "'s' AS subject", "'m' AS message",
    )
    found = dashboard.inbox_latest(rows).collect()
    assert {r.id for r in found} == {4, 5, 6, 7, 8}
    assert [r.received for r in found if r.id == 8] == ["09-01-2024 01:02"]


def test_counts_show_empty_kinds(spark, cat):
    class Empty:
        def __getattr__(self, name):
            return getattr(cat, name).where(F.lit(False))

    assert {r.n for r in dashboard.dashboard_counts(Empty()).collect()} == {0}
