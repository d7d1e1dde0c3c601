"""A site map kept in shards, of which only the changed ones are written again.

Below the folder lie ``shards/shard=<s>/*.xml`` (addresses dealt by a hash of loc), ``states/run=<n>`` (one digest per shard) and
``index/*.xml``, the protocol's index file with one entry per file of a shard.  The number of shards is fixed by the first
run.  A run compares digests, replaces the shards that differ (dynamic partition overwrite), then the index, and last
stores its state, one file that is there as a whole or not at all: a run cut off at any moment is run again, and replaces the
same shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exports import URLS_PER_FILE, URLSET

# Fixed values of the site map protocol.
INDEX = 'sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
MAPS_PER_INDEX = 50_000

FIELDS = ("loc", "lastmod", "changefreq", "priority")
STATE = "shard int, n long, mixed long, total decimal(38,0), shards int"


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("loc"), F.lit(shards)).cast("int").alias("shard")


def _addresses(urls: DataFrame) -> DataFrame:
    """The protocol's fields in their order; those the input lacks are NULL and left out of the files."""
    have = set(urls.columns)
    return urls.select(*[(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in FIELDS]).where("loc IS NOT NULL")


def shard_digests(urls: DataFrame, shards: int) -> DataFrame:
    """Rows and two order-free digests of every shard that holds any; three numbers per shard and task are shuffled.

    A field's presence is part of its hash, so a date that vanishes counts as a change.
    """
    parts = [part for c in FIELDS for part in (F.col(c).isNull(), F.col(c))]
    line = F.xxhash64(*parts)
    return _addresses(urls).select(_shard(shards), line.alias("line")).groupBy("shard").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("line").alias("mixed"),
        F.sum(F.col("line").cast("decimal(20,0)")).cast("decimal(38,0)").alias("total"),
    )


def _runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATE + ", run int").parquet(f"{path}/states")


def _last_state(spark: SparkSession, path: str) -> tuple[int, int, dict[int, tuple]]:
    """Number of the last run, number of shards, and every shard's figures; (0, 0, {}) before the first run.

    One row per shard reaches the driver, as many as there are files to name in the index.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/states")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return 0, 0, {}
    runs = _runs(spark, path)
    last = runs.agg(F.max("run")).first()[0]
    if last is None:
        return 0, 0, {}
    rows = runs.where(F.col("run") == last).collect()
    return last, rows[0].shards, {r.shard: (r.n, r.mixed, r.total) for r in rows if r.shard is not None}


def _write_index(spark: SparkSession, path: str, base: str, shards: list[int]) -> None:
    """The index names every file of the shards that hold addresses, with the day it was written."""
    named = spark.createDataFrame([], "loc string, lastmod string")
    if shards:
        files = spark.read.format("binaryFile").load(f"{path}/shards").where(F.col("shard").isin(shards))
        named = files.select(
            F.concat(F.lit(base.rstrip("/") + "/"), F.concat_ws("/", F.slice(F.split("path", "/"), -2, 2))).alias("loc"),
            F.date_format("modificationTime", "yyyy-MM-dd").alias("lastmod"),
        )
    (
        named.coalesce(1).sortWithinPartitions("loc").write.mode("overwrite").format("xml")
        .option("rootTag", INDEX).option("rowTag", "sitemap").option("maxRecordsPerFile", MAPS_PER_INDEX).save(f"{path}/index")
    )


def update_sitemap(urls: DataFrame, path: str, base: str, per_file: int = URLS_PER_FILE) -> list[int]:
    """Bring the site map below ``path`` to the given addresses; gives the shards that were written again or emptied.

    ``urls`` has loc, changefreq, priority and may have lastmod; rows without loc are left out, repeated rows are kept.  The first
    run takes shards for half of ``per_file`` addresses each; a shard that grows beyond ``per_file`` later becomes several files.
    ``urls`` must be the same rows at every reading.  Two runs on one folder must not overlap.
    """
    spark = urls.sparkSession
    last, shards, known = _last_state(spark, path)
    if not last:
        shards = max(1, math.ceil(_addresses(urls).count() / max(1, per_file // 2)))
    now = {r.shard: (r.n, r.mixed, r.total) for r in shard_digests(urls, shards).collect()}
    changed = sorted(s for s in {*known, *now} if known.get(s) != now.get(s))
    if last and not changed:
        return []
    again = [s for s in changed if s in now]
    rows = _addresses(urls).withColumn("shard", _shard(shards))
    if len(again) < len(now):
        rows = rows.where(F.col("shard").isin(again))
    (
        rows.repartition("shard").sortWithinPartitions("shard", "loc").write.partitionBy("shard").mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").format("xml").option("rootTag", URLSET).option("rowTag", "url")
        .option("maxRecordsPerFile", per_file).save(f"{path}/shards")
    )
    _write_index(spark, path, base, sorted(now))
    state = [(s, *figures, shards) for s, figures in sorted(now.items())] + [(None, None, None, None, shards)]
    spark.createDataFrame(state, STATE).coalesce(1).write.mode("overwrite").parquet(f"{path}/states/run={last + 1}")
    return changed


def read_sharded_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """The addresses of all shards that hold any."""
    _, _, known = _last_state(spark, path)
    columns = ", ".join(f"{c} string" for c in FIELDS)
    if not known:
        return spark.createDataFrame([], columns)
    rows = spark.read.format("xml").option("rowTag", "url").schema(columns + ", shard int").load(f"{path}/shards")
    return rows.where(F.col("shard").isin(sorted(known))).drop("shard")
