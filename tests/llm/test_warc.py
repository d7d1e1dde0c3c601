"""Archives: round trip, SQL, and salvage of damaged files."""

import io
import zlib

import pytest
from compare import database, differences

from weftbook.llm import warc
from weftbook.llm.queries import ORACLE, QUERIES


def test_whole_table(spark, sf_dir):
    assert differences(QUERIES["op6_warc_salvage"](spark, sf_dir), database(sf_dir), ORACLE["op6_warc_salvage"]) == []


BIG = "<p>" + "é" * 600 + "</p>"
PAGES = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, None, BIG), (4, "http://a/4 x\r\ny", "small"), (5, "http://é/5", "small"),
    (6, "u", None), (7, "u", ""), (8, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (9, "u", "z" * 3_000_000), (10, "u", "a" * 999),
    (11, "u", "a" * 999), (12, "u", "b" * 1000), (12, "u", "b" * 1000),
]


def test_hand_made(spark, sf_dir):
    rows = [(*p, "x") for p in PAGES] + [(None, "u", BIG, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    found = {}
    for r in warc.read_back(warc.archive_pages(pages)).collect():
        found.setdefault(r.page_id, []).append((r.payload_bytes, r.record_type, r.refers_to))
    assert found[1] == found[2] == [(len(BIG.encode()), "revisit", 3)]
    assert found[None] == [(len(BIG.encode()), "revisit", 3)]
    assert found[3] == [(len(BIG.encode()), "response", None)]
    assert found[6] == found[7] == [(0, "response", None)]
    assert found[10] == found[11] == [(999, "response", None)]
    assert found[12] == [(1000, "response", None)] * 2
    assert found[9] == [(3_000_000, "response", None)]
    assert sum(map(len, found.values())) == len(rows)


def test_payloads_come_back(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = warc.run_folder(spark, "warc")
    manifest = warc.write_archives(warc.page_records(pages), folder, archive_bytes=1500)
    assert manifest.count() > 2 and manifest.agg({"records": "sum"}).first()[0] == len(PAGES)
    found = {r.page_id: (r.payload, r.url) for r in warc.read_archives(manifest).collect()}
    assert found[9][0] == b"z" * 3_000_000 and found[3][0] == BIG.encode() and found[1][0] is None
    assert found[4][1] == "http://a/4%20x%0D%0Ay" and found[5][1] == "http://é/5" and found[3][1] == "urn:unknown"


def test_empty_table(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def record(page, payload=b"p" * 50):
    import hashlib

    return warc.encode_record({
        "page_id": page, "url": "u", "payload": payload, "payload_bytes": len(payload), "record_type": "response",
        "refers_to": None, "payload_digest": hashlib.sha1(payload).hexdigest(),
    })


def read(data, block=warc.BLOCK):
    records, gaps = [], []
    for kind, start, end, found in warc.salvage(io.BytesIO(data), block):
        if kind == "gap":
            gaps.append((start, end))
        else:
            records.append(warc._page_of(found["head"]["warc-record-id"]))
    return records, gaps


@pytest.mark.parametrize("block", [16, 1 << 20])
@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed, block):
    form = warc._member if packed else bytes
    parts = [form(record(i)) for i in range(4)]
    whole = b"".join(parts)
    assert read(whole, block) == ([0, 1, 2, 3], [])
    first, second = len(parts[0]), len(parts[0]) + len(parts[1])
    # a changed byte in the second record
    hurt = bytearray(whole)
    hurt[second - 20] ^= 0xFF
    assert read(bytes(hurt), block) == ([0, 2, 3], [(first, second)])
    # junk between records, and before the first one
    assert read(b"junk" + parts[0] + b"\x1f\x8b\x08 no" + parts[1], block) == ([0, 1], [(0, 4), (4 + first, 4 + first + 6)])
    # the end is cut
    assert read(whole[:-7], block) == ([0, 1, 2], [(len(whole) - len(parts[3]), len(whole) - 7)])
    # nothing but junk, and nothing
    assert read(b"x" * 5000, block) == ([], [(0, 5000)])
    assert read(b"", block) == ([], [])


def test_mixed_and_grouped_members():
    both = zlib.compressobj(6, zlib.DEFLATED, 31)
    grouped = both.compress(record(1) + record(2)) + both.flush()
    assert read(record(0) + grouped + warc._member(record(3)) + record(4)) == ([0, 1, 2, 3, 4], [])


def packed(*parts):
    both = zlib.compressobj(6, zlib.DEFLATED, 31)
    return both.compress(b"".join(parts)) + both.flush()


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_damage_inside_a_member(block):
    one, two, three = (record(i, bytes([64 + i]) * 300) for i in (1, 2, 3))
    hurt = two[:-50] + b"x" + two[-49:]
    member = packed(one, hurt, three)
    rows = list(warc.salvage(io.BytesIO(record(0) + member + record(4)), block))
    pages = [warc._page_of(r[3]["head"]["warc-record-id"]) for r in rows if r[0] == "record"]
    assert pages == [0, 1, 3, 4]
    at = len(record(0))
    gaps = [r[1:] for r in rows if r[0] == "gap"]
    assert gaps == [(at, at + len(member), ("block digest differs", len(one), len(one) + len(two)))]


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_member_that_breaks_off(block):
    import random

    noise = random.Random(1)
    parts = [record(i, noise.randbytes(4000)) for i in range(6)]
    member = packed(*parts)
    cut = member[: len(member) // 2]
    assert read(cut, block) == ([0, 1], [(0, len(cut))])
    assert read(cut + warc._member(record(9)), block) == ([0, 1, 9], [(0, len(cut))])
    last = [found for kind, _, _, found in warc.salvage(io.BytesIO(cut), block) if kind == "gap"][0]
    assert last[1] == len(parts[0]) + len(parts[1])
    # a wrong checksum: records with a digest of their own count but for the last, others do not
    wrong = member[:-8] + b"\0\0\0\0" + member[-4:]
    assert read(wrong, block)[0] == [0, 1, 2, 3, 4]
    bare = b"\r\n".join(line for line in record(7).split(b"\r\n") if not line.startswith(b"WARC-Block-Digest"))
    assert read(packed(bare), block) == ([7], [])
    broken = packed(bare)[:-8] + bytes(8)
    assert read(broken, block) == ([], [(0, len(broken))])


def test_lengths_that_cannot_be_true_are_not_read():
    class Counting(io.BytesIO):
        taken = 0

        def read(self, size=-1):
            out = super().read(size)
            self.taken += len(out)
            return out

    false = record(1).replace(b"Content-Length: ", b"Content-Length: 99999999")
    data = false + record(2) + b"z" * 3_000_000
    file = Counting(data)
    rows = warc.salvage(file, 1 << 14)
    assert next(rows)[:3] == ("gap", 0, len(false)) and next(rows)[0] == "record"
    assert file.taken < 100_000


def test_many_records_in_one_member():
    parts = [record(i, bytes([i % 250]) * 5000) for i in range(3000)]
    data = packed(*parts)
    assert read(data) == (list(range(3000)), [])


def test_gaps_are_rows(spark, tmp_path):
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"??" + warc._member(record(7)))
    rows = warc.read_archives(spark.createDataFrame([(f"file://{path}",)], "path string")).collect()
    assert [(r.kind, r.start, r.end, r.page_id) for r in rows][0] == ("gap", 0, 2, None)
    assert [(r.kind, r.page_id, r.payload) for r in rows][1] == ("record", 7, b"p" * 50)
