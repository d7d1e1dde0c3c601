"""What several of the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftbook.session import run_folder

# A key with at least this share of all rows is looked up by broadcast; at most HOT_KEYS keys can have it.
HOT_KEYS = 1024
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back, so that its work is never repeated.

    Everything downstream then rests on files that outlive any executor.
    """
    spark = df.sparkSession
    path = run_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lookup_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Left join of ``rows`` with ``groups`` (unique ``keys``, ``size`` rows each), whatever the skew.

    Groups with at least total / HOT_KEYS rows (no more than HOT_KEYS of them) are broadcast and their rows stay
    where they are; only the rest is shuffled.  Both inputs are read twice and should be stored or cheap.
    """
    least = max(total // HOT_KEYS, 1000)
    hot = groups.filter(F.col(size) >= least)
    popular = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    rest = rest.join(groups.filter(F.col(size) < least), keys, "left")
    return popular.unionByName(rest)


def small_batches(df: DataFrame) -> DataFrame:
    """The same frame; from here on the session hands Python BATCH_ROWS rows at a time, as rows hold whole texts.

    A session that sets a size of its own keeps it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":  # Spark's default
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def text_runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts (null: empty), the first two columns, in runs of about ``size`` characters."""
    docs, texts, chars = [], [], 0
    for batch in batches:
        for doc, text in zip(*batch.columns[:2]):
            docs.append(doc.as_py())
            texts.append(text.as_py() or "")
            chars += len(texts[-1])
            if chars >= size:
                yield docs, texts
                docs, texts, chars = [], [], 0
    if docs:
        yield docs, texts


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
