"""The site map kept in shards: what an edit rewrites, crashes, and the index file."""

import glob
import os

from pyspark.sql import functions as F

from weftbook.sources import sitemapshards as shards

FIELDS = "loc string, lastmod string, changefreq string, priority string"
BASE = "https://example.org/maps/"


def addresses(spark, n=200):
    return spark.range(n).selectExpr(
        "concat('https://example.org/news/a&b-', id) AS loc", "IF(id % 3 = 0, NULL, '2024-05-06') AS lastmod",
        "'weekly' AS changefreq", "'0.8' AS priority",
    )


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/shards/*/*.xml")}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def contents(spark, path):
    return sorted((tuple(r) for r in shards.read_sharded_sitemap(spark, path).collect()), key=str)


def indexed(spark, path):
    found = spark.read.format("xml").option("rowTag", "sitemap").schema("loc string, lastmod string").load(f"{path}/index")
    return sorted(r.loc for r in found.collect())


def named(path):
    return sorted(BASE + os.path.relpath(f, f"{path}/shards") for f in files(path))


def test_one_edit_rewrites_one_shard(spark, tmp_path):
    path, first = str(tmp_path), addresses(spark)
    every = shards.update_sitemap(first, path, BASE, per_file=20)
    assert len(every) == 20 and contents(spark, path) == rows(first) and indexed(spark, path) == named(path)
    before = files(path)
    assert shards.update_sitemap(first, path, BASE, per_file=20) == [] and files(path) == before
    edited = first.withColumn("lastmod", F.when(F.col("loc").endswith("-77"), F.lit("2024-06-01")).otherwise(F.col("lastmod")))
    changed = shards.update_sitemap(edited, path, BASE, per_file=20)
    after = files(path)
    assert len(changed) == 1 and contents(spark, path) == rows(edited) and indexed(spark, path) == named(path)
    touched = {os.path.dirname(f) for f in {*before, *after} if before.get(f) != after.get(f)}
    assert touched == {f"{path}/shards/shard={changed[0]}"}


def test_a_date_that_vanishes_and_repeated_rows_are_changes(spark, tmp_path):
    path, first = str(tmp_path), addresses(spark, 30)
    shards.update_sitemap(first, path, BASE, per_file=20)
    bare = first.withColumn("lastmod", F.when(~F.col("loc").endswith("-4"), F.col("lastmod")))
    assert len(shards.update_sitemap(bare, path, BASE)) == 1 and contents(spark, path) == rows(bare)
    thrice = bare.unionByName(bare.limit(1)).unionByName(bare.limit(1))
    assert len(shards.update_sitemap(thrice, path, BASE)) == 1 and len(contents(spark, path)) == 32


def test_shards_that_run_empty_grow_over_the_limit_and_come_back(spark, tmp_path):
    path, first = str(tmp_path), addresses(spark, 40)
    shards.update_sitemap(first, path, BASE, per_file=20)
    gone = shards.update_sitemap(first.limit(0), path, BASE, per_file=20)
    assert gone == [0, 1, 2, 3] and contents(spark, path) == []
    assert shards.update_sitemap(addresses(spark, 400), path, BASE, per_file=20) == [0, 1, 2, 3]
    assert contents(spark, path) == rows(addresses(spark, 400)) and indexed(spark, path) == named(path)
    assert len(files(path)) >= 20


def test_a_run_cut_off_before_its_state_is_run_again(spark, tmp_path, monkeypatch):
    path, first = str(tmp_path), addresses(spark, 60)
    shards.update_sitemap(first, path, BASE, per_file=20)

    def stop(*_):
        raise RuntimeError("cut off")

    with monkeypatch.context() as patch:
        patch.setattr(shards, "_write_index", stop)
        try:
            shards.update_sitemap(addresses(spark, 61), path, BASE)
        except RuntimeError:
            pass
    assert len(shards.update_sitemap(addresses(spark, 61), path, BASE)) == 1
    assert contents(spark, path) == rows(addresses(spark, 61)) and indexed(spark, path) == named(path)


def test_nothing_at_all_and_other_columns(spark, tmp_path):
    none = spark.createDataFrame([(None, "x", 1)], "loc string, shard string, line int")
    assert shards.update_sitemap(none, str(tmp_path / "a"), BASE) == [] and contents(spark, str(tmp_path / "a")) == []
    one = spark.createDataFrame([("https://h/1", "x", 1)], "loc string, shard string, line int")
    assert shards.update_sitemap(one, str(tmp_path / "a"), BASE) == [0]
    assert contents(spark, str(tmp_path / "a")) == [("https://h/1", None, None, None)]
