"""All row rules of a table in one pass, against the separate reports."""

from functools import reduce

from pyspark.sql import DataFrame

from weftbook.operators import integrity
from weftbook.schemas import TABLES
from weftbook.sources import catalogue


def test_row_rules_are_the_three_reports_in_one_scan(spark, tmp_path):
    rows = [
        (1, "abc", "draft", None), (2, "abcdef", "gone", "x"), (2, "abcdef", "gone", "x"), (2, "abcdefg", None, None),
        (None, "abcdefgh", "", "toolongtoo"), (None, None, "published", "y"), (7, "\U0001F9F5" * 5, "gone", "z"),
    ]
    spark.createDataFrame(rows, "id long, title string, status string, note string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    required, limits, domains = ["id", "title", "status"], {"title": 5, "note": 4}, {"status": ("draft", "published")}
    parts = [
        integrity.missing_values(df, "t", required), integrity.too_long(df, "t", limits), integrity.outside_domain(df, "t", domains),
    ]
    wanted = sorted(map(str, reduce(DataFrame.unionByName, parts).collect()))
    found = integrity.row_rules(df, "t", required, limits, domains)
    assert found.columns == parts[0].columns and sorted(map(str, found.collect())) == wanted and len(wanted) == 10
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert integrity.row_rules(df.where("false"), "t", required, limits, domains).count() == 0
    assert integrity.row_rules(df, "t", ["note"]).first().n == 2


def test_a_write_reports_what_it_stores_without_a_second_scan(spark, tmp_path):
    schema = TABLES["news_articles"].struct()
    good = spark.range(4).selectExpr("id", "concat('t', id) AS title", "concat('t-', id) AS slug", "IF(id = 2, 'gone', 'draft') AS status")
    long = good.where("id < 2").selectExpr("id + 10 AS id", "repeat('x', 5000) AS title", "CAST(NULL AS STRING) AS slug", "status")
    df = catalogue.conform(good.unionByName(long), "news_articles")
    rule = TABLES["news_articles"]
    found = {(r.rule, r.column_name): r.n for r in catalogue.write_checked(df, str(tmp_path), "news_articles").collect()}
    stored = catalogue.read_table(spark, str(tmp_path), "news_articles").select(*schema.fieldNames())
    assert found.pop(("rows", None)) == 6 == stored.count()
    reports = integrity.row_rules(df, "news_articles", rule.required(), rule.lengths(), rule.domains)
    wanted = {}
    for row in reports.collect():
        key = (row.rule, row.column_name)
        wanted[key] = wanted.get(key, 0) + (1 if row.rule == "length" else row.n)
    assert found == wanted and found[("domain", "status")] == 1 and found[("length", "title")] == 2
    again = catalogue.write_checked(df.limit(0), str(tmp_path / "none"), "news_articles").collect()
    assert [(r.rule, r.column_name, r.n) for r in again] == [("rows", None, 0)]
