"""Stored blocks: batches against the frame version, folders rewritten, kept counts, runs cut off."""

import os

import pytest
from pyspark.sql import functions as F

from weftbook.operators import changes
from weftbook.sources import blocks

ROW = (
    "id long, title string, slug string, category_id long, status string, published_at timestamp_ntz, created_at timestamp_ntz,"
    " updated_at timestamp_ntz"
)
CHANGE = "op string, change_id long, id long, changed_at timestamp_ntz, title string, slug string, category_id string, status string"
FIELDS = ["title", "slug", "category_id", "status"]


def table(spark, n):
    return spark.range(n).selectExpr(
        "id", "concat('t', id) AS title", "concat('s-', id) AS slug", "IF(id % 5 = 0, NULL, id % 3) AS category_id",
        "IF(id % 2 = 0, 'draft', 'published') AS status", "IF(id % 2 = 0, NULL, TIMESTAMP_NTZ'2024-01-01 00:00:00') AS published_at",
        "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS created_at", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS updated_at",
    )


def batch(spark, rows):
    frame = spark.createDataFrame(rows, CHANGE.replace("timestamp_ntz", "string"))
    return frame.withColumn("changed_at", F.col("changed_at").cast("timestamp_ntz"))


BATCHES = [
    [("create", 1, 100, "2024-02-01", "New", None, "1", "published"), ("edit", 2, 3, "2024-02-02", "Three", "", "", "archived"),
     ("delete", 3, 17, None, None, None, None, None), ("edit", 4, 100, "2024-02-03", "Newer", "", "2", "draft")],
    [("edit", 5, 100, "2024-03-01", "Newest", "", "2", "published"), ("delete", 6, 3, None, None, None, None, None),
     ("edit", 7, 4, "2024-03-01", "Four", "", "7", "published"), ("edit", 8, 4, "2024-03-01", "Four!", "", "7", "draft"),
     ("create", 9, 101, "2024-03-02", "Gone at once", None, None, None), ("delete", 10, 101, None, None, None, None, None)],
    [("delete", 11, 100, None, None, None, None, None), ("edit", 12, 5000, "2024-04-01", "Nowhere", "", "", "draft"),
     ("edit", 13, 20, "2024-04-01", "Twenty", "", "1", "published"), ("delete", 14, 20, None, None, None, None, None),
     ("delete", 15, 20, None, None, None, None, None), ("edit", 16, 17, "2024-04-01", "Late", "", "", "draft")],
]


def state(df):
    return sorted(map(str, df.select(*[c.split()[0] for c in ROW.split(", ")]).collect()))


def counted(df):
    return {(r.status, r.category_id): r["count"] for r in df.groupBy("status", "category_id").count().collect()}


def kept(spark, root):
    return {(r.status, r.category_id): r.n for r in blocks.stored_counts(spark, root).collect()}


def files(root):
    return {d: sorted(os.listdir(f"{root}/rows/{d}")) for d in os.listdir(f"{root}/rows") if d.startswith("block=")}


@pytest.fixture
def root(spark, tmp_path):
    blocks.write_blocks(table(spark, 64), str(tmp_path / "t"), bits=4)
    return str(tmp_path / "t")


def test_three_batches_and_the_folders_they_rewrite(spark, root):
    frame = table(spark, 64)
    assert kept(spark, root) == counted(frame)
    for number, rows in enumerate(BATCHES, 1):
        asked, old = batch(spark, rows), files(root)
        frame = changes.apply_changes(frame, asked, FIELDS)
        touched = blocks.apply_batch(spark, root, number, asked, FIELDS)
        assert touched == sorted({r[2] >> 4 for r in rows})
        new = files(root)
        assert {d for d in new if old.get(d) != new[d]} == {f"block={b}" for b in touched if f"block={b}" in new}
        assert all(old[d] == new[d] for d in old if int(d.split("=")[1]) not in touched)
        assert state(blocks.read_blocks(spark, root)) == state(frame)
        assert kept(spark, root) == counted(frame)


def test_a_batch_run_again_changes_nothing(spark, root):
    asked = batch(spark, BATCHES[0])
    blocks.apply_batch(spark, root, 1, asked, FIELDS)
    rows, counts = state(blocks.read_blocks(spark, root)), kept(spark, root)
    blocks.apply_batch(spark, root, 1, asked, FIELDS)
    assert state(blocks.read_blocks(spark, root)) == rows and kept(spark, root) == counts
    blocks.apply_batch(spark, root, 2, batch(spark, BATCHES[1]), FIELDS)
    with pytest.raises(ValueError):
        blocks.apply_batch(spark, root, 1, asked, FIELDS)


@pytest.mark.parametrize("done", [0, 1, 2])
def test_run_cut_off(spark, root, monkeypatch, done):
    """Stopped after the counts, and with ``done`` of the touched blocks rewritten."""
    asked, write = batch(spark, BATCHES[0]), blocks._write_rows

    def part(df, folder, bits):
        chosen = [0, 1, 6][:done]
        if chosen:
            write(df.where(F.shiftright("id", bits).isin(chosen)), folder, bits)
        raise RuntimeError("lost")

    monkeypatch.setattr(blocks, "_write_rows", part)
    with pytest.raises(RuntimeError):
        blocks.apply_batch(spark, root, 1, asked, FIELDS)
    monkeypatch.undo()
    blocks.apply_batch(spark, root, 1, asked, FIELDS)
    expected = changes.apply_changes(table(spark, 64), asked, FIELDS)
    assert state(blocks.read_blocks(spark, root)) == state(expected)
    assert kept(spark, root) == counted(expected)


def test_ids_that_were_given_are_not_given_again(spark, root):
    blocks.apply_batch(spark, root, 1, batch(spark, [("delete", 1, 5, None, None, None, None, None)]), FIELDS)
    again = [("create", 2, i, "2024-05-01", "Again", None, None, "draft") for i in (5, 6, 200, 200)]
    blocks.apply_batch(spark, root, 2, batch(spark, again), FIELDS)
    found = {r.id: r.title for r in blocks.read_blocks(spark, root).collect()}
    assert 5 not in found and found[6] == "t6" and found[200] == "Again" and len(found) == 64
    assert sum(kept(spark, root).values()) == 64


def test_a_whole_block_deleted_and_empty_tables(spark, root, tmp_path):
    gone = [("delete", i, i, None, None, None, None, None) for i in range(16, 32)]
    assert blocks.apply_batch(spark, root, 1, batch(spark, gone), FIELDS) == [1]
    assert sorted(r.id for r in blocks.read_blocks(spark, root).collect()) == [*range(16), *range(32, 64)]
    empty = str(tmp_path / "empty")
    blocks.write_blocks(table(spark, 0), empty)
    assert blocks.read_blocks(spark, empty).count() == 0 and kept(spark, empty) == {}
    assert blocks.apply_batch(spark, empty, 1, batch(spark, []), FIELDS) == []
    blocks.apply_batch(spark, empty, 1, batch(spark, BATCHES[1]), FIELDS)
    assert blocks.read_blocks(spark, empty).count() == 0


def test_only_touched_blocks_are_read(spark, root):
    rows = blocks._stored_rows(spark, root).where(F.col("block").isin([1, 2]))
    assert {name.split("block=")[1].split("/")[0] for name in rows.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]} == {"1", "2"}
    assert all("/t/counts/" in name for name in blocks.stored_counts(spark, root).inputFiles())
