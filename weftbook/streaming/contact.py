"""Intake of contact messages as a stream, and the overview's latest messages.

A store has two parts.  ``messages`` holds every message in a folder per run (one
checkpoint is one run) and micro-batch.  A batch that is run again replaces its own folder,
so a batch that failed half-way leaves no trace; a message that any other batch has stored,
also of an earlier run over the same source, is recognised by id and fields and not stored again.
``inbox`` holds the latest few messages, merged batch by batch.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.dashboard import INBOX as INBOX_SIZE
from ..operators.feeds import newest_first
from ..operators.intake import check_messages

BATCH_FILES = 200  # files of a backlog that one micro-batch takes
CONFLICT = "Another message has this id"

MESSAGE = (
    T.StructType()
    .add("id", T.LongType())
    .add("name", T.StringType())
    .add("email", T.StringType())
    .add("subject", T.StringType())
    .add("message", T.StringType())
    .add("created_at", T.TimestampNTZType())
)
CHECKED = T.StructType([*MESSAGE, T.StructField("is_read", T.BooleanType()), T.StructField("reject_reason", T.StringType())])


def _with_folders(schema: T.StructType, *names: str) -> T.StructType:
    return T.StructType([*schema, *[T.StructField(name, T.StringType()) for name in names]])


STORED = _with_folders(CHECKED, "run", "batch", "outcome")
BOXES = _with_folders(MESSAGE, "run", "box")


def run_name(checkpoint: str) -> str:
    """A run is known by where it keeps its progress."""
    return hashlib.md5(checkpoint.encode()).hexdigest()[:16]


def stored_messages(spark: SparkSession, store: str) -> DataFrame:
    """All messages taken in so far, with run, batch and outcome."""
    return spark.read.schema(STORED).parquet(f"{store}/messages")


def accepted_messages(spark: SparkSession, store: str) -> DataFrame:
    stored = stored_messages(spark, store).where(F.col("outcome") == "accepted")
    return stored.select(*MESSAGE.names, "is_read")


def rejected_messages(spark: SparkSession, store: str) -> DataFrame:
    return stored_messages(spark, store).where(F.col("outcome") == "rejected")


def _elsewhere(run: str, part: str, number: int) -> Column:
    """Folders other than the one this batch is about to write."""
    return (F.col("run") != run) | (F.col(part) != str(number))


def _stored_near(batch: DataFrame, store: str) -> DataFrame | None:
    """The stored messages within the batch's range of ids, None for a batch without rows.

    Ids rise as messages arrive, so only files that reach into this batch's range of ids
    are read: the range goes to the file scan as a filter.
    """
    sides = {"given": F.col("id") >= 0, "made": F.col("id") < 0}  # ids made by with_ids are below zero
    borders = batch.agg(*[f(F.when(side, F.col("id"))) for side in sides.values() for f in (F.min, F.max)]).first()
    ranges = [(low, high) for low, high in zip(borders[::2], borders[1::2]) if low is not None]
    if not ranges:
        return None
    inside = reduce(lambda a, b: a | b, [F.col("id").between(low, high) for low, high in ranges])
    return stored_messages(batch.sparkSession, store).where(inside)


def _join_same(batch: DataFrame, stored: DataFrame, how: str, stamped: bool) -> DataFrame:
    """Join on the id and all fields; times that were stamped on arrival are no fields of a message."""
    names = [c for c in MESSAGE.names if not (stamped and c == "created_at")]
    stored = stored.select(*[F.col(c).alias(f"__{c}") for c in names])
    return batch.join(stored, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in names]), how)


def _unseen(batch: DataFrame, run: str, number: int, store: str, stamped: bool) -> DataFrame:
    """Rows that no other batch has stored; ``__known`` marks those whose id another batch has stored with other fields."""
    near = _stored_near(batch, store)
    if near is None:
        return batch.withColumn("__known", F.lit(False))
    others = near.where(_elsewhere(run, "batch", number))
    known = others.select("id").distinct().withColumn("__known", F.lit(True))
    return _join_same(batch, others, "left_anti", stamped).join(known, "id", "left")


def with_ids(messages: DataFrame) -> DataFrame:
    """Give messages without id one: the day it came, then a digest of all its fields, below zero.

    The same message sent again gets the same id; messages that differ in any field do not share one (but for a
    chance of one in 2^48 per pair of a day, which ``store_batch`` then shows as a conflict).  The day keeps ids in order of
    arrival, so that looking for repeats reads few files.
    """
    others = [f for f in MESSAGE.names if f != "id"]
    day = F.coalesce(F.unix_date(F.col("created_at").cast("date")), F.lit(0)).cast("bigint")
    texts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in others]
    digest = F.pmod(F.xxhash64(*texts), F.lit(1 << 48))
    return messages.withColumn("id", F.coalesce("id", -(F.pmod(day, F.lit(32767)) * F.lit(1 << 48) + digest + 1)))


def with_file_ids(files: DataFrame) -> DataFrame:
    """Give messages without id one from where they stand: the day their file was written, then a digest of its path and the row's number.

    ``files`` is a frame read from Parquet files, before anything else is done with it; a column ``id`` that it has is
    kept where it is set.  Equal messages are then two messages, in one batch or in several, and the same file read again,
    after a failure or by another run, gives the same ids.  Two rows share one by a chance of one in 2^48 per pair of a day,
    which ``store_batch`` then shows as a conflict.
    """
    day = F.coalesce(F.unix_date(F.col("_metadata.file_modification_time").cast("date")), F.lit(0)).cast("bigint")
    digest = F.pmod(F.xxhash64("_metadata.file_path", "_metadata.row_index"), F.lit(1 << 48))
    made = -(F.pmod(day, F.lit(32767)) * F.lit(1 << 48) + digest + 1)
    return files.withColumn("id", F.coalesce("id", made) if "id" in files.columns else made)


def store_batch(batch: DataFrame, number: int, store: str, run: str, stamped: bool = False) -> None:
    """Check, stamp and store one micro-batch; running it twice gives the same rows.

    Of different messages under one id the one of the batch that came first counts, within a batch the first by its fields;
    the others are stored as rejected.  ``stamped`` says that created_at is the moment of arrival, which does not tell messages apart.
    """
    fields = [c for c in MESSAGE.names if c != "id"]
    place = F.row_number().over(Window.partitionBy("id").orderBy("created_at", *[c for c in fields if c != "created_at"]))
    distinct = with_ids(batch).dropDuplicates(MESSAGE.names).withColumn("__place", place)
    checked = check_messages(_unseen(distinct, run, number, store, stamped))
    conflict = (F.col("__place") > 1) | F.coalesce("__known", F.lit(False))
    checked = checked.withColumn("reject_reason", F.when(conflict, CONFLICT).otherwise(F.col("reject_reason")))
    outcome = F.when(F.col("reject_reason").isNull(), "accepted").otherwise("rejected")
    (
        checked.select(*CHECKED.names, outcome.alias("outcome"))
        .write.mode("overwrite")
        .partitionBy("outcome")
        .parquet(f"{store}/messages/run={run}/batch={number}")
    )


def _boxes(spark: SparkSession, store: str) -> DataFrame:
    # A box may be replaced while it is read; the other boxes hold what matters.
    return spark.read.schema(BOXES).option("ignoreMissingFiles", "true").parquet(f"{store}/inbox")


def _latest(messages: DataFrame, n: int) -> DataFrame:
    return messages.select(*MESSAGE.names).dropDuplicates(["id"]).orderBy(*newest_first("created_at")).limit(n)


def latest_messages(spark: SparkSession, store: str, n: int = INBOX_SIZE) -> DataFrame:
    """The latest accepted messages: at most two small boxes per run are read."""
    return _latest(_boxes(spark, store), n)


def refresh_inbox(batch: DataFrame, number: int, store: str, run: str, n: int = INBOX_SIZE, stamped: bool = False) -> None:
    """Merge the latest ``n`` of this batch that the store holds as accepted into the inbox.

    Two boxes per run take turns: the one of the batch before is read while this one is
    replaced.  Merging the same messages again changes nothing.
    """
    box = number % 2
    batch = with_ids(batch)
    near = _stored_near(batch, store)
    valid = batch if near is None else _join_same(batch, near.where(F.col("outcome") == "accepted"), "left_semi", stamped)
    before = _boxes(batch.sparkSession, store).where(_elsewhere(run, "box", box))
    (
        _latest(before.select(*MESSAGE.names).unionByName(_latest(valid, n)), n)
        .coalesce(1)
        .write.mode("overwrite")
        .parquet(f"{store}/inbox/run={run}/box={box}")
    )


def open_store(spark: SparkSession, store: str) -> None:
    """Lay out empty folders, so that reading before the first batch gives no rows."""
    for folder, schema in (("messages/run=none/batch=none/outcome=none", CHECKED), ("inbox/run=none/box=none", MESSAGE)):
        none = spark.range(0, 0, 1, 1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
        none.write.mode("ignore").parquet(f"{store}/{folder}")


def start_intake(messages: DataFrame, store: str, checkpoint: str, inbox: bool = True) -> StreamingQuery:
    """Take in a stream of messages up to its present end.

    ``messages`` is a streaming frame with id, name, email, subject, message and
    created_at; a source that lacks the last is given the moment of arrival here.  Messages without
    id should get one from their source (``with_file_ids``, or the offset of a queue): what has none here gets one
    from its fields, so that equal ones of a day count as one message.
    """
    run = run_name(checkpoint)
    stamped = "created_at" not in messages.columns
    messages = arrival_stamp(messages)
    open_store(messages.sparkSession, store)

    def take(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            store_batch(batch, number, store, run, stamped)
            if inbox:
                refresh_inbox(batch, number, store, run, stamped=stamped)
        finally:
            batch.unpersist()

    return (
        messages.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def arrival_stamp(messages: DataFrame) -> DataFrame:
    """Give messages from a source without times the moment of arrival."""
    if "created_at" in messages.columns:
        return messages
    return messages.withColumn("created_at", F.current_timestamp().cast("timestamp_ntz"))
