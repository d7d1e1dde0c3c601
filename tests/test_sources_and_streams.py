"""Files in and out, and the message stream, in temporary folders."""

import json
import xml.etree.ElementTree as ET
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftbook.functions.images import BAD_FORMAT, MAX_BYTES, TOO_LARGE
from weftbook.operators import feeds, intake, sitemap
from weftbook.schemas import TABLES
from weftbook.session import run_folder, shared_folder
from weftbook.sources import catalogue, exports, uploads
from weftbook.streaming import contact


def lines(folder):
    return [json.loads(line) for f in sorted(Path(folder).glob("part-*.json")) for line in f.read_text().splitlines()]


def test_feed_files_keep_order_and_nulls(cat, tmp_path):
    feed = feeds.article_feed(cat.news_articles, cat.news_categories)
    exports.write_feed(feed, str(tmp_path / "feed"))
    written = lines(tmp_path / "feed")
    assert [r["id"] for r in written] == [r.id for r in feed.collect()]
    assert all(set(r) == set(feed.columns) for r in written)
    assert written[0]["published_at"] is None


def test_sitemap_files(cat, tmp_path):
    urls = sitemap.sitemap(cat, "https://h/")
    exports.write_sitemap(urls.coalesce(1), str(tmp_path / "map"), per_file=200)
    files = sorted((tmp_path / "map").glob("part-*"))
    space = "{http://www.sitemaps.org/schemas/sitemap/0.9}"
    records = []
    for file in files:
        root = ET.parse(file).getroot()
        assert root.tag == f"{space}urlset" and len(root) <= 200
        records += [{child.tag.removeprefix(space): child.text for child in url} for url in root]
    assert len(files) > 1
    assert sorted(r["loc"] for r in records) == sorted(r.loc for r in urls.collect())
    assert all(set(r) == {"loc", "changefreq", "priority"} for r in records)


def test_uploads(spark, tmp_path):
    folder = tmp_path / "up"
    (folder / "deep").mkdir(parents=True)
    (folder / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"x" * 20)
    (folder / "deep" / "b.txt").write_bytes(b"<svg/>")
    (folder / "c.gif").write_bytes(b"GIF89a" + b"0" * (MAX_BYTES - 6))
    (folder / "d.gif").write_bytes(b"GIF89a" + b"0" * (MAX_BYTES - 5))
    files = uploads.read_uploads(spark, str(folder))
    checked = {r.filename: r for r in intake.check_uploads(files).collect()}
    assert checked["a.png"].reject_reason is None and checked["a.png"].file_size == 28
    assert checked["b.txt"].reject_reason == BAD_FORMAT
    assert checked["c.gif"].file_type == "image/gif" and checked["c.gif"].reject_reason is None
    assert checked["d.gif"].reject_reason == TOO_LARGE and checked["d.gif"].header is None


def test_uploads_end_to_end(spark, tmp_path):
    folder = tmp_path / "up"
    folder.mkdir()
    (folder / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"x" * 20)
    (folder / "b.txt").write_bytes(b"<svg/>")
    files = uploads.read_uploads(spark, str(folder), uploaded_by=4)
    (row,) = intake.media_rows(intake.check_uploads(files)).collect()
    assert (row.filename, row.file_size, row.uploaded_by_id) == ("a.png", 28, 4)
    assert row.filepath.startswith("/static/uploads/") and row.filepath.endswith(".png")
    assert [r.id for r in uploads.read_uploads(spark, str(folder)).where("filename = 'a.png'").collect()] == [row.id]
    unnamed = files.withColumn("filename", F.lit(" ").cast("string")).withColumn("filename", F.trim("filename"))
    assert {r.reject_reason for r in intake.check_uploads(unnamed).collect()} == {"No file selected."}


def test_messages_without_id_are_kept_apart(spark, tmp_path):
    store, run = str(tmp_path / "store"), "r"
    contact.open_store(spark, store)
    rows = [(None, "a", "e", "s", "one"), (None, "b", "e", "s", "two"), (None, "a", "e", "s", "one"), (5, "c", "e", "s", "three"),
            (5, "c", "e", "s", "other words")]
    moment = F.expr("TIMESTAMP_NTZ'2024-05-01 10:00:00'")
    batch = spark.createDataFrame(rows, "id bigint, name string, email string, subject string, message string")
    batch = batch.withColumn("created_at", moment)
    contact.store_batch(batch, 0, store, run)
    contact.store_batch(batch, 1, store, run)  # sent again
    found = contact.stored_messages(spark, store).collect()
    assert sorted(r.message for r in found if r.outcome == "accepted") == ["one", "other words", "two"]
    assert [(r.message, r.reject_reason) for r in found if r.outcome == "rejected"] == [("three", contact.CONFLICT)]
    assert all(r.id < 0 for r in found if r.message in ("one", "two")) and len({r.id for r in found}) == 3


def test_stored_catalogue_answers_like_the_tables(spark, cat, tmp_path):
    catalogue.write_table(cat.companies, str(tmp_path), "companies")
    stored = catalogue.read_catalogue(spark, str(tmp_path))
    assert stored.companies.count() == cat.companies.count() and stored.spark is spark
    assert dict(stored.companies.dtypes)["id"] == "bigint" and stored.companies.columns[0] == "id"
    with pytest.raises(AttributeError):
        stored.nothing


def test_tables_are_stored_by_status(spark, cat, tmp_path):
    jobs = catalogue.conform(cat.jobs, "jobs")
    catalogue.write_table(jobs, str(tmp_path), "jobs")
    back = catalogue.read_table(spark, str(tmp_path), "jobs")
    assert set(back.columns) == set(TABLES["jobs"].columns) and back.count() == jobs.count()
    plan = feeds.published(back)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(status" in plan


def test_database_addresses():
    assert catalogue.database_url("postgres://h/d") == "jdbc:postgresql://h/d"
    assert catalogue.database_url("postgresql://h/d") == "jdbc:postgresql://h/d"
    assert catalogue.database_url("jdbc:other:x") == "jdbc:other:x"


def test_run_folders_are_new(spark):
    first, second = run_folder(spark, "x"), run_folder(spark, "x")
    assert first != second and first.startswith(shared_folder(spark))


MESSAGES = "id bigint, name string, email string, subject string, message string, created_at timestamp_ntz"


def arrivals(spark, low, high):
    return spark.range(low, high).selectExpr(
        "id", "CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'n' END AS name", "'e' AS email", "'s' AS subject",
        "concat('m', id) AS message", "timestampadd(MINUTE, CAST(id AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS created_at",
    )


def intake_run(spark, source, store, checkpoint, files=1):
    stream = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", files).parquet(str(source))
    contact.start_intake(stream, str(store), str(checkpoint)).awaitTermination()


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.fixture()
def source(spark, tmp_path):
    for low in (0, 40, 80):
        arrivals(spark, low, low + 40).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return tmp_path / "in"


def test_intake_in_several_batches(spark, source, tmp_path):
    store = tmp_path / "store"
    intake_run(spark, source, store, tmp_path / "cp")
    taken, refused = contact.accepted_messages(spark, str(store)), contact.rejected_messages(spark, str(store))
    assert ids(taken) == [i for i in range(120) if i % 4 > 1]
    assert ids(refused) == [i for i in range(120) if i % 4 < 2]
    assert {r.reject_reason for r in refused.collect()} == {intake.MISSING}
    assert not taken.where("is_read").count()
    assert ids(contact.latest_messages(spark, str(store))) == [111, 114, 115, 118, 119]
    # More of the source later: the stream goes on where it stopped.
    arrivals(spark, 120, 124).coalesce(1).write.mode("append").parquet(str(source))
    intake_run(spark, source, store, tmp_path / "cp")
    assert ids(contact.stored_messages(spark, str(store))) == list(range(124))
    assert ids(contact.latest_messages(spark, str(store))) == [115, 118, 119, 122, 123]


@pytest.mark.parametrize("files_per_batch", [1, 3])
def test_replay_under_a_new_checkpoint_adds_and_loses_nothing(spark, source, tmp_path, files_per_batch):
    store = tmp_path / "store"
    intake_run(spark, source, store, tmp_path / "cp1", 4 - files_per_batch)
    before = sorted(map(str, contact.stored_messages(spark, str(store)).drop("run", "batch").collect()))
    intake_run(spark, source, store, tmp_path / "cp2", files_per_batch)
    after = sorted(map(str, contact.stored_messages(spark, str(store)).drop("run", "batch").collect()))
    assert after == before
    assert ids(contact.latest_messages(spark, str(store))) == [111, 114, 115, 118, 119]


def test_new_run_over_new_files_keeps_the_old_messages(spark, source, tmp_path):
    """Batch numbers start again at 0 under a new checkpoint."""
    store = tmp_path / "store"
    intake_run(spark, source, store, tmp_path / "cp1")
    arrivals(spark, 500, 501).unionByName(arrivals(spark, 502, 503)).coalesce(1).write.parquet(str(tmp_path / "in2"))
    intake_run(spark, tmp_path / "in2", store, tmp_path / "cp2")
    assert ids(contact.stored_messages(spark, str(store))) == [*range(120), 500, 502]
    assert ids(contact.latest_messages(spark, str(store))) == [114, 115, 118, 119, 502]


def test_same_batch_twice(spark, tmp_path):
    store, run = str(tmp_path / "store"), "r"
    contact.open_store(spark, store)
    batch = arrivals(spark, 0, 20)
    for _ in range(2):
        contact.store_batch(batch.unionByName(batch), 0, store, run)
        contact.refresh_inbox(batch, 0, store, run)
    assert ids(contact.stored_messages(spark, store)) == list(range(20))
    assert ids(contact.latest_messages(spark, store)) == [11, 14, 15, 18, 19]
    contact.store_batch(batch.where(F.lit(False)), 1, store, run)
    contact.refresh_inbox(batch.where(F.lit(False)), 1, store, run)
    assert ids(contact.latest_messages(spark, store)) == [11, 14, 15, 18, 19]


def test_other_message_under_a_known_id_is_stored_as_rejected(spark, tmp_path):
    store = str(tmp_path / "store")
    contact.open_store(spark, store)
    message = lambda text, at="2024-05-01 10:00:00", name="n": spark.createDataFrame(
        [(5, name, "e", "s", text)], "id bigint, name string, email string, subject string, message string"
    ).withColumn("created_at", F.expr(f"TIMESTAMP_NTZ'{at}'"))
    turns = [("r", 0, message("one")), ("r", 1, message("two", "2024-05-02 10:00:00")), ("q", 0, message("two", "2024-05-02 10:00:00")),
             ("q", 1, message("one", name=None)), ("q", 2, message("one"))]
    for run, number, batch in turns:
        for _ in range(2):
            contact.store_batch(batch, number, store, run)
            contact.refresh_inbox(batch, number, store, run)
    found = sorted((r.outcome, r.message, r.name or "", r.reject_reason or "") for r in contact.stored_messages(spark, store).collect())
    assert found == [("accepted", "one", "n", ""), ("rejected", "one", "", contact.CONFLICT), ("rejected", "two", "n", contact.CONFLICT)]
    assert [r.message for r in contact.latest_messages(spark, store).collect()] == ["one"]
    contact.store_batch(message("one", "2024-06-01 10:00:00"), 3, store, "q", stamped=True)  # the same message, stamped later
    assert contact.stored_messages(spark, store).count() == 3


def test_arrival_stamp(spark):
    plain = spark.range(1)
    assert contact.arrival_stamp(plain).first().created_at is not None
    stamped = contact.arrival_stamp(plain)
    assert contact.arrival_stamp(stamped) is stamped


FORM = "name string, email string, subject string, message string"


def form_run(spark, source, store, checkpoint, files):
    stream = spark.readStream.schema(FORM).option("maxFilesPerTrigger", files).parquet(str(source))
    contact.start_intake(contact.with_file_ids(stream), str(store), str(checkpoint)).awaitTermination()


@pytest.mark.parametrize("files", [1, 2])
def test_messages_without_id_are_kept_once_each(spark, tmp_path, files):
    """Equal messages in one file and in two, in one batch and in two, replayed, restarted and read by a second run."""
    rows = [("n", "e", "s", "same")] * 2 + [("n", "e", "s", "other"), ("", "e", "s", "bad"), ("", "e", "s", "bad")]
    source, store = tmp_path / "in", tmp_path / "store"
    for _ in range(2):
        spark.createDataFrame(rows, FORM).coalesce(1).write.mode("append").parquet(str(source))

    def stored():
        return sorted((r.message, r.outcome, r.id, r.created_at) for r in contact.stored_messages(spark, str(store)).collect())

    form_run(spark, source, store, tmp_path / "cp1", files)
    first = stored()
    assert [m[:2] for m in first] == [("bad", "rejected")] * 4 + [("other", "accepted")] * 2 + [("same", "accepted")] * 4
    assert len({m[2] for m in first}) == 10
    form_run(spark, source, store, tmp_path / "cp1", files)  # nothing new
    form_run(spark, source, store, tmp_path / "cp2", 3 - files)  # a second run over the same source
    assert stored() == first
    spark.createDataFrame(rows[:1], FORM).coalesce(1).write.mode("append").parquet(str(source))
    form_run(spark, source, store, tmp_path / "cp1", files)
    form_run(spark, source, store, tmp_path / "cp2", files)
    assert len(stored()) == 11 and sum(m[0] == "same" for m in stored()) == 5
    assert contact.latest_messages(spark, str(store)).count() == 5


def test_ids_of_the_source_stay(spark, tmp_path):
    schema = "id bigint, " + FORM
    spark.createDataFrame([(7, "n", "e", "s", "m"), (None, "n", "e", "s", "m")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    ids_found = [r.id for r in contact.with_file_ids(spark.read.schema(schema).parquet(str(tmp_path / "in"))).collect()]
    assert 7 in ids_found and min(ids_found) < 0
