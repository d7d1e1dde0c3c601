"""Uploaded files read from storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.images import HEADER_BYTES, MAX_BYTES


def read_uploads(spark: SparkSession, path: str, uploaded_by: int | None = None) -> DataFrame:
    """Files under ``path``: an id made from the path, name, size, first twelve bytes, and who uploaded them.

    Files over the size limit are listed without reading them: the limit is a filter on
    the file length, which the source applies before it opens a file.  So no task ever
    holds more than five MiB of one file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("filename")
    common = [F.xxhash64("path").alias("id"), F.lit(uploaded_by).cast("bigint").alias("uploaded_by_id"), "path", name, F.col("length").alias("file_size"), F.col("modificationTime").cast("timestamp_ntz").alias("created_at")]
    fitting = files.where(F.col("length") <= MAX_BYTES)
    oversize = files.where(F.col("length") > MAX_BYTES)
    return fitting.select(*common, F.substring("content", 1, HEADER_BYTES).alias("header")).unionByName(
        oversize.select(*common, F.lit(None).cast("binary").alias("header"))
    )
