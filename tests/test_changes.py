"""Creates, edits, deletes, integrity reports and seeds on hand-made rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weftbook.operators import changes, integrity
from weftbook.schemas import TABLES, TRANSLATED
from weftbook.sources.catalogue import conform

T = [datetime(2024, 1, d) for d in range(1, 10)]
FIELDS = ["title", "slug", "summary", "category_id", "status"]
BASE = "id bigint, title string, slug string, summary string, category_id bigint, status string, published_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz"
EDIT = "change_id bigint, id bigint, changed_at timestamp_ntz, title string, slug string, category_id string, status string"


@pytest.fixture()
def base(spark):
    return spark.createDataFrame(
        [
            (1, "One", "one", "s", 5, "draft", None, T[0], T[0]),
            (2, "Two", "two", "s", 5, "published", T[0], T[0], T[0]),
            (3, "Three", "three", "s", 5, "draft", None, T[0], T[0]),
        ],
        BASE,
    )


def by_id(df):
    return {r.id: r for r in df.collect()}


def test_rows_without_a_key_are_not_inserted(spark):
    base = spark.createDataFrame([(1, "a")], "id bigint, k string")
    new = spark.createDataFrame([(2, None), (3, None), (4, "b"), (5, "a")], "id bigint, k string")
    once = changes.insert_absent(base, new, "k")
    assert sorted(r.id for r in once.collect()) == [1, 4]
    assert sorted(r.id for r in changes.insert_absent(once, new, "k").collect()) == [1, 4]
    assert sorted(r.id for r in changes.without_key(new, "k").collect()) == [2, 3]


def test_first_publishing_edit_sets_the_date(spark, base):
    edits = spark.createDataFrame(
        [
            (1, 1, T[1], "A", "", "", "published"),
            (2, 1, T[2], "B", "", "7", "draft"),
            (3, 1, T[3], "C d", "", "", "published"),
            (4, 2, T[4], "E", "Keep This", "8", None),
            (5, 77, T[4], "no such row", "", "", "published"),
        ],
        EDIT,
    )
    found = by_id(changes.apply_edits(base, edits, FIELDS))
    assert set(found) == {1, 2, 3}
    one, two, three = found[1], found[2], found[3]
    assert (one.title, one.slug, one.category_id, one.status) == ("C d", "c-d", None, "published")
    assert one.published_at == T[1] and one.updated_at == T[3] and one.created_at == T[0]
    assert one.summary is None  # the edit did not send it
    assert (two.slug, two.category_id, two.status, two.published_at) == ("keep_this", 8, "draft", T[0])
    assert three.title == "Three" and three.summary == "s" and three.updated_at == T[0]


def test_edits_of_the_same_moment_follow_their_number(spark, base):
    edits = spark.createDataFrame(
        [(2, 1, T[1], "later", "", "", "draft"), (1, 1, T[1], "earlier", "", "", "draft")], EDIT
    )
    assert by_id(changes.apply_edits(base, edits, FIELDS))[1].title == "later"


def test_creates(spark, base):
    rows = [(10, T[5], "New One", None, "", "published"), (11, T[5], "X", "Y Z", "3", None)]
    new = spark.createDataFrame(rows, "id bigint, changed_at timestamp_ntz, title string, slug string, category_id string, status string")
    found = by_id(changes.apply_creates(base, new))
    assert (found[10].slug, found[10].category_id, found[10].published_at, found[10].created_at) == ("new-one", None, T[5], T[5])
    assert (found[11].slug, found[11].category_id, found[11].status, found[11].published_at) == ("y_z", 3, "draft", None)
    listing = by_id(changes.apply_creates(base.drop("published_at"), new, changes.LISTING_DEFAULT))
    assert listing[11].status == "published"


def test_deletes_and_outcomes(spark, base):
    asked = spark.createDataFrame([(1,), (1,), (9,)], "id bigint")
    assert set(by_id(changes.apply_deletes(base, asked))) == {2, 3}
    assert {(r.id, r.found) for r in changes.delete_outcomes(base, asked).collect()} == {(1, True), (9, False)}


def small_catalogue(spark):
    frame = spark.createDataFrame
    return {
        "users": frame([(1,), (2,)], "id bigint"),
        "company_categories": frame([(1,)], "id bigint"),
        "companies": frame([(1, 1), (2, None)], "id bigint, category_id bigint"),
        "jobs": frame([(1, 1), (2, 1), (3, 2)], "id bigint, company_id bigint"),
        "services": frame([(1, 1), (2, 2)], "id bigint, provider_id bigint"),
        "news_articles": frame([(1, None, 1), (2, None, 2)], "id bigint, category_id bigint, author_id bigint"),
        "news_tags": frame([(1, 1), (2, 1)], "news_id bigint, tag_id bigint"),
        "tags": frame([(1,)], "id bigint"),
        "media": frame([(1, 1), (2, None)], "id bigint, uploaded_by_id bigint"),
    }


def ids(df, column="id"):
    return sorted((r[column] for r in df.collect()), key=str)


def test_company_delete_takes_jobs_and_services(spark):
    gone = spark.createDataFrame([(1,)], "id bigint")
    left = changes.delete_rows(small_catalogue(spark), "companies", gone, TABLES)
    assert ids(left["companies"]) == [2] and ids(left["jobs"]) == [3] and ids(left["services"]) == [2]


def test_article_delete_takes_its_tag_rows(spark):
    gone = spark.createDataFrame([(1,)], "id bigint")
    left = changes.delete_rows(small_catalogue(spark), "news_articles", gone, TABLES)
    assert ids(left["news_articles"]) == [2] and ids(left["news_tags"], "news_id") == [2] and ids(left["tags"]) == [1]


def test_user_and_category_delete_empty_the_keys(spark):
    gone = spark.createDataFrame([(1,)], "id bigint")
    left = changes.delete_rows(small_catalogue(spark), "users", gone, TABLES)
    assert ids(left["news_articles"]) == [1, 2] and ids(left["news_articles"], "author_id") == [2, None]
    assert ids(left["media"], "uploaded_by_id") == [None, None]
    left = changes.delete_rows(small_catalogue(spark), "company_categories", gone, TABLES)
    assert ids(left["companies"], "category_id") == [None, None]


@pytest.mark.parametrize("limit", [0, 10**9])
def test_children_without_a_key_stay(spark, limit):
    children = spark.createDataFrame([(1, 1), (2, None), (3, 2)], "id bigint, p bigint")
    gone = spark.createDataFrame([(1,), (1,)], "id bigint")
    assert ids(changes.remove_children(children, "p", gone, broadcast_bytes=limit)) == [2, 3]
    released = changes.release_children(children, "p", gone, broadcast_bytes=limit)
    assert sorted((r.id, r.p) for r in released.collect() if r.p) == [(3, 2)] and released.count() == 3


def test_seed_run_twice_changes_nothing(spark):
    base = spark.createDataFrame([(1, "a")], "id bigint, slug string")
    seeds = spark.createDataFrame([(5, "a"), (6, "b"), (7, "b"), (8, "c")], "id bigint, slug string")
    once = changes.insert_absent(base, seeds, "slug")
    assert {(r.id, r.slug) for r in once.collect()} == {(1, "a"), (6, "b"), (8, "c")}
    assert sorted(map(str, changes.insert_absent(once, seeds, "slug").collect())) == sorted(map(str, once.collect()))


def test_translation_columns(spark):
    assert sum(len(changes.translation_columns(t)) for t in TRANSLATED) == 66
    df = spark.createDataFrame([(1, "n", "d")], "id bigint, name string, description string")
    wide = changes.add_translations(df, "services")
    assert wide.columns == ["id", "name", "description", "name_ta", "name_ta_en", "description_ta", "description_ta_en"]
    assert changes.add_translations(wide, "services").columns == wide.columns
    assert changes.drop_translations(wide, "services").columns == df.columns
    assert changes.merge_batches(df, wide).count() == 2


def test_reports(spark):
    rows = [(1, "aa", "x", 1, "published"), (2, "aa", None, 9, "odd"), (3, None, "yyy", None, None), (4, None, "z", 9, "draft")]
    df = spark.createDataFrame(rows, "id bigint, slug string, title string, p bigint, status string")
    parents = spark.createDataFrame([(1,)], "id bigint")
    got = lambda report: sorted((r.column_name, r.key, r.n) for r in report.collect())
    assert got(integrity.duplicates(df, "t", ["slug"])) == [("slug", "aa", 2)]
    assert [r.n for r in integrity.duplicates(df, "t", ["slug"], digest=True).collect()] == [2]
    assert got(integrity.missing_values(df, "t", ["id", "slug", "title"])) == [("slug", None, 2), ("title", None, 1)]
    assert got(integrity.orphans(df, "t", "p", parents)) == [("p", "9", 2)]
    assert got(integrity.orphans(df, "t", "p", parents, broadcast_bytes=0)) == [("p", "9", 2)]
    assert got(integrity.too_long(df, "t", {"title": 2, "slug": 2})) == [("title", "3", 3)]
    assert got(integrity.outside_domain(df, "t", {"status": ("published", "draft")})) == [("status", "odd", 1)]


def test_all_rules_over_the_catalogue(cat):
    tables = {name: getattr(cat, name) for name in TABLES}
    report = integrity.check_tables(tables, TABLES).groupBy("table_name", "rule", "column_name").count().collect()
    found = {(r.table_name, r.rule, r.column_name) for r in report}
    assert ("contact_messages", "not null", "name") in found
    assert ("news_articles", "foreign key", "author_id") in found
    assert not [f for f in found if f[1] == "unique"]


def test_declared_schemas(spark):
    assert len(TABLES) == 16
    for name, table in TABLES.items():
        empty = conform(spark.range(0), name)
        assert [f.name for f in empty.schema] == list(table.columns)
        for parent, _ in table.foreign_keys.values():
            assert parent in TABLES
    assert TABLES["jobs"].lengths()["location"] == 150
    assert "published_at" not in TABLES["news_articles"].required()


def test_hot_key_edits_are_cut_before_the_shuffle(spark, base):
    many = spark.range(3000).select(
        F.col("id").alias("change_id"), F.lit(1).cast("bigint").alias("id"),
        F.expr("make_timestamp_ntz(2024, 2, 1, 0, CAST(id % 60 AS INT), 0)").alias("changed_at"),
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"), F.lit("").alias("slug"),
        F.lit("").alias("category_id"), F.lit("draft").alias("status"),
    )
    assert by_id(changes.apply_edits(base, many, FIELDS))[1].title == "t2999"
