"""WARC archives: a writer with revisit records, and a reader that salvages what it can from damaged files.

Writer: payload digests are grouped before any payload moves; the page that answers for a group is its largest page_id,
and only pages without an equal of at least REVISIT_BYTES carry their payload.  Every task writes its own archives, one
gzip member per record, under a name given by its partition; an archive appears under that name only when complete.

Reader: archives are dealt out by path and read record by record.  When a member's checksum, a version line, a length
or a digest fails, the reader searches for the next gzip mark or version line whose record passes all checks,
goes on there, and reports the bytes between as a gap.  Inside a member it does the same on the plain bytes, also on those
that come before the place where a member breaks off.  It holds one member's packed bytes and one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftbook.llm.common import lookup_groups, stored
from weftbook.session import run_folder

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
BLOCK = 1 << 20
HELD_BYTES = 8 << 20  # records of one member that wait for its checksum
MEMBER = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
CAPTURED = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

MANIFEST = "path string, records long, bytes long"
RECORDS = (
    "kind string, path string, start long, end long, reason string, record_type string, page_id long, url string, "
    "refers_to long, payload_bytes long, payload_digest string, payload binary, inner_start long, inner_end long"
)
MANIFEST_ARROW = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
RECORDS_ARROW = pa.schema(
    [("kind", pa.string()), ("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string()),
     ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()),
     ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
     ("inner_start", pa.int64()), ("inner_end", pa.int64())]
)


def page_records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Pages with payload, payload_bytes, payload_digest, record_type and refers_to; revisits carry no payload."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    full = pages.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload).alias("payload_digest"),
    )
    digests = full.select("page_id", "payload_bytes", "payload_digest")
    groups = stored(
        digests.filter(F.col("payload_bytes") >= revisit_bytes)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("answer"), F.count("*").alias("n"))
        .filter("n > 1"),
        "payload-groups",
    )
    total = groups.agg(F.sum("n")).first()[0] or 0
    revisit = F.col("answer").isNotNull() & ~F.col("answer").eqNullSafe(F.col("page_id"))
    known = lookup_groups(full, groups, ["payload_digest"], "n", total) if total else full.withColumn(
        "answer", F.lit(None).cast("long")
    )
    return known.select(
        "page_id", "url", "payload_bytes", "payload_digest",
        F.when(revisit, F.lit(None)).otherwise(F.col("payload")).alias("payload"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("answer")).alias("refers_to"),
    )


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a shared path: a URI that Arrow knows, or a plain path."""
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _urn(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _page_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _base32(hexadecimal: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def encode_record(row: dict) -> bytes:
    """One record as bytes, without compression."""
    block = HTTP_HEAD + (row["payload"] or b"")
    url = "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) for b in (row["url"] or "").encode()) if row[
        "url"
    ] else "urn:unknown"
    head = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", _urn(row["page_id"])),
        ("WARC-Target-URI", url.encode("latin-1").decode("utf-8")),
        ("WARC-Date", CAPTURED),
        ("WARC-Payload-Digest", _base32(row["payload_digest"])),
        ("WARC-Payload-Length", str(row["payload_bytes"])),
        ("WARC-Block-Digest", _base32(hashlib.sha1(block).hexdigest())),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if row["record_type"] == "revisit":
        head[5:5] = [("WARC-Refers-To", _urn(row["refers_to"])), ("WARC-Profile", PROFILE)]
    lines = "".join(f"{name}: {value}\r\n" for name, value in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of ``page_records`` below a shared ``folder``; returns the manifest: path, records, bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = _filesystem(folder)
        store.create_dir(base, recursive=True)
        number, out, count, size, names = 0, None, 0, 0, ("", "")

        def finish():
            out.close()
            store.move(names[0], names[1])
            name = posixpath.basename(names[1])
            return pa.RecordBatch.from_pylist(
                [{"path": f"{folder.rstrip('/')}/{name}", "records": count, "bytes": size}], MANIFEST_ARROW
            )

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"pages-{task.partitionId():06d}-{number:04d}.warc.gz"
                    names = (f"{base}/{name}.{task.taskAttemptId()}.part", f"{base}/{name}")
                    out, count, size = store.open_output_stream(names[0], compression=None), 0, 0
                member = _member(encode_record(row))
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= archive_bytes:
                    yield finish()
                    number, out = number + 1, None
        if out is not None:
            yield finish()

    return stored(records.mapInArrow(work, MANIFEST), "warc-manifest")


class Damage(Exception):
    """A check of the record at the present place failed."""


class Window:
    """A file seen through a sliding buffer."""

    def __init__(self, file, block: int = BLOCK):
        self.file, self.block, self.base, self.data, self.ended = file, block, 0, b"", False
        self.size = None  # of the file, where it is known
        if hasattr(file, "seek"):
            self.size = file.seek(0, 2)
            file.seek(0)

    def more(self) -> bool:
        piece = b"" if self.ended else self.file.read(self.block)
        self.ended = not piece
        self.data += piece
        return bool(piece)

    def get(self, at: int, length: int) -> bytes:
        """Up to ``length`` bytes from place ``at`` of the file."""
        while at + length > self.base + len(self.data) and self.more():
            pass
        return self.data[at - self.base : at - self.base + length]

    def drop(self, before: int) -> None:
        if before - self.base > self.block:
            self.data = self.data[before - self.base :]
            self.base = before

    def find(self, marks: tuple[bytes, ...], at: int) -> int | None:
        """The first place from ``at`` on where one of the marks stands."""
        while True:
            found = [p for p in (self.data.find(m, at - self.base) for m in marks) if p >= 0]
            if found:
                return self.base + min(found)
            at = max(at, self.base + len(self.data) - max(map(len, marks)) + 1)
            self.drop(at)
            if not self.more():
                return None


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at a place of plain bytes and where it ends; raises Damage if any check fails."""
    end = data.find(b"\r\n\r\n", at)
    if not data.startswith(VERSION, at) or end < 0:
        raise Damage("no version line or no end of headers")
    head: dict[str, str] = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damage("header without a colon")
        head[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not head.get("content-length", "").isdigit():
        raise Damage("no content length")
    start, length = end + 4, int(head["content-length"])
    block = data[start : start + length]
    if len(block) < length or data[start + length : start + length + 4] != b"\r\n\r\n":
        raise Damage("block is cut or not closed")
    digest = head.get("warc-block-digest")
    if digest and digest != _base32(hashlib.sha1(block).hexdigest()):
        raise Damage("block digest differs")
    return {"head": head, "block": block}, start + length + 4


class Unpacker:
    """The plain bytes of the gzip member at a place of a window, piece by piece; ``damage`` says why they end too early."""

    def __init__(self, window: Window, at: int):
        self.window, self.place, self.opener, self.damage, self.given = window, at, zlib.decompressobj(31), "", 0

    def read(self, size: int) -> bytes:
        out = b""
        while not (out or self.opener.eof or self.damage):
            piece = self.window.get(self.place, 1 << 14)  # at most 16 MB when unpacked
            if not piece:
                self.damage = "gzip member is cut"
                break
            before = self.opener.copy()
            try:
                out = self.opener.decompress(piece)
                self.place += len(piece) - len(self.opener.unused_data)
            except zlib.error as error:
                self.damage, out = f"gzip: {error}", self._up_to_damage(before, piece)
        self.given += len(out)
        return out

    def _up_to_damage(self, opener, piece: bytes) -> bytes:
        """What can be unpacked of a piece before the byte at which it fails."""
        parts = []
        for at in range(len(piece)):
            try:
                parts.append(opener.decompress(piece[at : at + 1]))
            except zlib.error:
                break
        return b"".join(parts)


def _plain_record(window: Window, at: int) -> tuple[dict, int]:
    size = 1 << 13
    while b"\r\n\r\n" not in (data := window.get(at, size)):
        if len(data) < size or size > 1 << 20:
            raise Damage("no end of headers")
        size *= 2
    end = data.index(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*(\d{1,18})\s*$", data[:end].replace(b"\r\n", b"\n"))
    if not length:
        raise Damage("no content length")
    total = end + 4 + int(length[1]) + 4
    if window.size is not None and at + total > window.size:  # nothing is read for a length that cannot be true
        raise Damage("block is cut")
    data = window.get(at, total)
    if len(data) < total:
        raise Damage("block is cut")
    return parse_record(data)[0], at + total


def _read(window: Window, at: int, marks: tuple[bytes, ...]) -> Iterator[tuple[str, int, object]]:
    """Records and inner gaps of the member or plain record at a place, each with an end; returns where it ends.

    Raises Damage if nothing there is whole, or behind the records that were.  In a member that breaks off or whose
    checksum fails, only records with a digest of their own that are followed by more bytes are whole.
    """
    mark = window.get(at, len(VERSION))
    if mark == VERSION:
        found, end = _plain_record(window, at)
        yield "record", end, found
        return end
    if MEMBER not in marks or not mark.startswith(MEMBER):
        raise Damage("neither a gzip mark nor a version line")
    unpacker = Unpacker(window, at)
    sure, unsure, gaps, size, passed, last = [], [], [], 0, 0, None
    for kind, start, end, found in salvage(unpacker, window.block, (VERSION,)):
        if kind == "gap":
            gaps.append((found[0], start, end))
            continue
        if size > HELD_BYTES:
            for record in sure:
                yield "record", unpacker.place, record
            sure, size = [], 0
        passed, last = end, (start, found)
        (sure if "warc-block-digest" in found["head"] else unsure).append(found)
        size += len(found["block"])
    if unpacker.damage:
        # The record at whose very end the member breaks off is part of the damage.
        if last and passed == unpacker.given:
            passed = last[0]
            sure = [record for record in sure if record is not last[1]]
    else:
        sure = sure + unsure
    for record in sure:
        yield "record", unpacker.place, record
    if unpacker.damage:
        raise Damage(unpacker.damage, passed)
    if not passed:
        raise Damage(gaps[0][0] if gaps else "empty member")
    for gap in gaps:
        yield "gap", unpacker.place, gap
    return unpacker.place


def salvage(
    file, block: int = BLOCK, marks: tuple[bytes, ...] = (MEMBER, VERSION)
) -> Iterator[tuple[str, int, int, object]]:
    """All that can be read of an open file: ('record', start, end, record) and ('gap', start, end, (reason, from, to)).

    start and end are places in the file.  For damage inside a gzip member that is otherwise whole, they are the member's, and from
    and to are places in its plain bytes; for a member that broke off, from is the place behind its last whole record.
    """
    window, at, lost, reason = Window(file, block), 0, None, ("", None, None)
    while window.get(at, 1):
        window.drop(at)
        reader = _read(window, at, marks)
        while True:
            try:
                kind, end, found = next(reader)
            except StopIteration as stop:
                at = stop.value
                break
            except Damage as damage:
                if lost is None:
                    lost, reason = at, (str(damage.args[0]), damage.args[1] if len(damage.args) > 1 and damage.args[1] else None, None)
                at = window.find(marks, at + 1)  # the next mark whose record is whole
                break
            if lost is not None:
                yield "gap", lost, at, reason
                lost = None
            yield kind, at, end, found
        if at is None:
            break
    if lost is not None:
        yield "gap", lost, window.base + len(window.data), reason


def _described(kind: str, path: str, start: int, end: int, found) -> dict:
    row = dict.fromkeys(RECORDS_ARROW.names) | {"kind": kind, "path": path, "start": start, "end": end}
    if kind == "gap":
        return row | dict(zip(("reason", "inner_start", "inner_end"), found))
    head, block = found["head"], found["block"]
    payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
    digest, revisit = head.get("warc-payload-digest", ""), head.get("warc-type") == "revisit"
    try:
        named = base64.b32decode(digest.removeprefix("sha1:")).hex()
    except ValueError:
        named = None
    length = head.get("warc-payload-length", "")
    row |= {
        "record_type": head.get("warc-type"),
        "page_id": _page_of(head.get("warc-record-id")),
        "url": head.get("warc-target-uri"),
        "refers_to": _page_of(head.get("warc-refers-to")),
        "payload": None if revisit else payload,
        "payload_bytes": (int(length) if length.isdigit() else None) if revisit else len(payload),
        "payload_digest": named if revisit else hashlib.sha1(payload).hexdigest(),
    }
    if not revisit and named and named != row["payload_digest"]:
        row["reason"] = "payload digest differs"
    return row


def read_archives(paths: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps of the archives named in column ``path``.

    kind is 'record' or 'gap'; start and end are byte places in the archive; reason says why a gap's bytes failed; inner_start and
    inner_end are places in the plain bytes of a member that is damaged only in part (see ``salvage``).
    For revisits the payload is null and payload_bytes and payload_digest are those of the payload they stand for.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = _filesystem(path)
                rows: list[dict] = []
                size = 0
                with store.open_input_file(name) as file:
                    for kind, start, end, found in salvage(file):
                        row = _described(kind, path, start, end, found)
                        size += len(row["payload"] or b"")
                        rows.append(row if with_payload else row | {"payload": None})
                        if size > 8_000_000 or len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, RECORDS_ARROW)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, RECORDS_ARROW)

    return paths.select("path").mapInArrow(work, RECORDS)


def archive_pages(pages: DataFrame, folder: str | None = None, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write every page (page_id, url, html) as a record and read all archives back; the rows of ``read_archives``.

    Null html is an empty payload, a null url is written as urn:unknown, a null page_id comes back null; repeated rows
    are records of their own; other columns are ignored; an empty table gives no archive and no row.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or run_folder(spark, "warc")
    manifest = write_archives(page_records(pages, revisit_bytes), folder)
    many = max(1, min(manifest.count(), spark.sparkContext.defaultParallelism * 4))
    return read_archives(manifest.repartition(many), with_payload=False)


def read_back(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return records.filter("kind = 'record'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
