"""Checks of what comes in: contact messages and uploaded files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import images

# Fields a message must have, and the refusal.
REQUIRED = ("name", "email", "subject", "message")
MISSING = "Missing required fields"


def check_messages(messages: DataFrame) -> DataFrame:
    """Add ``is_read`` (false) and ``reject_reason`` (NULL if the message is complete)."""
    blank = reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit("")) == "" for c in REQUIRED])
    return messages.withColumns({"is_read": F.lit(False), "reject_reason": F.when(blank, MISSING)})


def check_uploads(files: DataFrame) -> DataFrame:
    """Add ``file_type``, ``extension`` and ``reject_reason`` from ``file_size`` and ``header``."""
    mime = images.mime_type(F.col("header"))
    return (
        files.withColumn("file_type", mime)
        .withColumn("extension", images.extension(F.col("file_type")))
        .withColumn("reject_reason", images.refusal(F.col("file_size"), F.col("file_type"), F.col("filename")))
    )


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reject_reason").isNotNull())


def media_rows(checked: DataFrame, folder: str = "/static/uploads/") -> DataFrame:
    """Accepted files as rows of the media table, under a path made from their id."""
    return accepted(checked).select(
        "id",
        "filename",
        F.concat(F.lit(folder), F.md5(F.col("id").cast("string")), F.col("extension")).alias("filepath"),
        "file_type",
        "file_size",
        "uploaded_by_id",
        "created_at",
    )
