"""Tables in buckets of the owner's key, and tables for point look-ups."""

import pytest
from pyspark.sql import functions as F

from weftbook.operators import feeds, relations
from weftbook.sources import colocated, pointfiles


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Companies 0 to 39; of 3,000 jobs a third belongs to company 7, some to none, some to one that does not exist."""
    companies = spark.range(40).selectExpr(
        "id", "concat('c', id) AS name", "concat('c-', id) AS slug", "IF(id % 9 = 0, 'draft', 'published') AS status"
    )
    owner = "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 10 = 1 THEN NULL ELSE id % 43 END"
    jobs = spark.range(3000).selectExpr(
        "id", f"{owner} AS company_id", "concat('j', id) AS title", "concat('j-', id) AS slug", "'published' AS status",
        "'full' AS job_type", "'x' AS location",
    )
    services = spark.range(500).selectExpr(
        "id", "CAST(id % 50 AS INT) AS provider_id", "concat('s', id) AS name", "concat('s-', id) AS slug", "'published' AS status",
        "'text' AS description",
    )
    root = str(tmp_path_factory.mktemp("colocated"))
    for name, df, key in (("companies", companies, "id"), ("jobs", jobs, "company_id"), ("services", services, "provider_id")):
        colocated.write_colocated(df, f"{root}/{name}", key, 4)
    return (companies, jobs, services), root


def opened(spark, root):
    return [colocated.Colocated(spark, f"{root}/{name}") for name in ("companies", "jobs", "services")]


def test_hot_and_missing_keys_lie_beside_the_buckets(spark, tables):
    (_, jobs, _), root = tables
    stored = colocated.Colocated(spark, f"{root}/jobs")
    assert stored.hot == [7] and rows(stored.rows) == rows(jobs.withColumn("company_id", F.col("company_id").cast("bigint")))
    assert stored.even.where("company_id IS NULL OR company_id = 7").count() == 0
    assert colocated.without_key(stored).count() == jobs.where("company_id IS NULL").count() > 0


def test_profiles_and_children_equal_those_of_plain_tables(spark, tables):
    (companies, jobs, services), root = tables
    c, j, s = opened(spark, root)
    services = services.withColumn("provider_id", F.col("provider_id").cast("bigint"))
    assert rows(colocated.by_owner(relations.company_profiles, c, j, s)) == rows(relations.company_profiles(companies, jobs, services))
    for build in (relations.children_of, relations.children_counts):
        found = colocated.by_owner(lambda p, k: build(p, k, "company_id", "jobs"), c, j)
        assert rows(found) == rows(build(companies, jobs, "company_id", "jobs"))


def test_large_sides_are_not_shuffled(spark, tables):
    _, root = tables
    c, j, s = opened(spark, root)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = colocated.by_owner(lambda p, k: feeds.jobs_with_company(k, p), c, j)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
        even = relations.company_profiles(c.even, j.even, s.even)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in even and "Exchange hashpartitioning" not in even
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_session_without_the_tables_opens_them_from_their_folder(spark, tables):
    (_, jobs, _), root = tables
    other = spark.newSession()
    spark.sql(f"DROP TABLE {colocated._table(root + '/jobs')}")
    stored = colocated.Colocated(other, f"{root}/jobs")
    assert stored.rows.count() == 3000 and stored.hot == [7]
    grouped = stored.even.groupBy("company_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in grouped


def test_empty_tables_and_unequal_buckets(spark, tmp_path):
    none = spark.createDataFrame([], "id long, company_id long")
    colocated.write_colocated(none, f"{tmp_path}/a", "id", 4)
    colocated.write_colocated(spark.createDataFrame([(1, None)], "id long, company_id long"), f"{tmp_path}/b", "company_id", 4)
    colocated.write_colocated(none, f"{tmp_path}/c", "company_id", 8)
    a, b, c = (colocated.Colocated(spark, f"{tmp_path}/{x}") for x in "abc")
    assert colocated.by_owner(lambda p, k: relations.children_of(p, k, "company_id", "r"), a, b).count() == 0
    assert colocated.without_key(b).count() == 1
    with pytest.raises(ValueError):
        colocated.by_owner(lambda p, k: p, a, c)


def scanned(df):
    """Rows that the scans of a collected frame handed on."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def visit(node):
        name = node.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            found.append(node.metrics().apply("numOutputRows").value())
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else []
        children = node.children()
        for child in inner + [children.apply(at) for at in range(children.size())]:
            visit(child)

    visit(plan)
    return sum(found)


def test_point_look_ups_open_few_row_groups(spark, tmp_path):
    df = spark.range(120_000).selectExpr("id * 7919 % 120011 AS id", "concat('slug-', lpad(id, 9, '0')) AS slug", "sha2(string(id), 512) AS text")
    path = str(tmp_path / "points")
    pointfiles.write_points(df, path, ["slug", "id"], row_group=1 << 20, values=20_000)

    def find(column, values):
        return pointfiles.find_points(spark, path, df.schema, column, values)

    wanted = df.where("slug IN ('slug-000000007', 'slug-000077777')")
    slugs = [row.slug for row in wanted.collect()]
    found = find("slug", [*slugs, slugs[0], None, "slug-none"])
    assert rows(found) == rows(wanted) and 0 < scanned(found) < 60_000
    some = find("id", [7919])
    assert rows(some) == rows(df.where("id = 7919")) and len(rows(some)) == 1 and scanned(some) < 60_000
    assert scanned(find("id", [119_999_999])) == 0
    between = 7919 * 120_005 % 120_011  # within the range of every row group, in none: only the filters can tell
    assert df.where(F.col("id") == between).count() == 0 and scanned(find("id", [between])) < 60_000
    assert find("id", []).count() == 0 and find("slug", [None]).count() == 0
    many = [row.id for row in df.limit(150).collect()]
    assert sorted(r.id for r in find("id", many).collect()) == sorted(many)
