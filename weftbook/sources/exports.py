"""Feeds as JSON records and site maps as XML files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the site map protocol.
URLS_PER_FILE = 50_000
URLSET = 'urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def json_record(df: DataFrame, columns: list[str] | None = None) -> Column:
    """One JSON object per row; NULL stays visible as null."""
    return F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"})


def write_feed(feed: DataFrame, path: str) -> None:
    """A feed as JSON lines, in the feed's order within and across files."""
    feed.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_sitemap(urls: DataFrame, path: str, per_file: int = URLS_PER_FILE) -> None:
    """Site map files of at most ``per_file`` addresses, each a document of its own.

    Needs columns loc, changefreq and priority, and may have lastmod; a NULL lastmod is
    left out of the record.
    """
    columns = [c for c in ("loc", "lastmod", "changefreq", "priority") if c in urls.columns]
    (
        urls.select(*columns)
        .write.mode("overwrite")
        .format("xml")
        .option("rootTag", URLSET)
        .option("rowTag", "url")
        .option("maxRecordsPerFile", per_file)
        .save(path)
    )


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """The addresses of site map files."""
    columns = "loc string, lastmod string, changefreq string, priority string"
    return spark.read.format("xml").option("rowTag", "url").schema(columns).load(path)
