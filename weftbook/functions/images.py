"""Image files: kind by first bytes, size limit, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size limit in bytes, first bytes of accepted kinds, and reasons.
MAX_BYTES = 5 * 1024 * 1024
HEADER_BYTES = 12
NO_FILE = "No file selected."
TOO_LARGE = "File size exceeds the 5MB maximum limit."
BAD_FORMAT = "Invalid file format."
EXTENSIONS = {"image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/webp": ".webp"}


def _starts(header: Column, hex_bytes: str, at: int = 1) -> Column:
    return F.substring(header, at, len(hex_bytes) // 2) == F.unhex(F.lit(hex_bytes))


def mime_type(header: Column) -> Column:
    """Media type of the first twelve bytes (a binary column), or NULL."""
    gif = _starts(header, b"GIF87a".hex()) | _starts(header, b"GIF89a".hex())
    webp = _starts(header, b"RIFF".hex()) & _starts(header, b"WEBP".hex(), at=9)
    return (
        F.when(_starts(header, "89504E470D0A1A0A"), "image/png")
        .when(_starts(header, "FFD8FF"), "image/jpeg")
        .when(gif, "image/gif")
        .when(webp, "image/webp")
    )


def extension(mime: Column) -> Column:
    pairs = [F.lit(text) for pair in EXTENSIONS.items() for text in pair]
    return F.try_element_at(F.create_map(*pairs), mime)


def refusal(size: Column, mime: Column, name: Column) -> Column:
    """Why a file is refused; NULL if it is accepted.  The name is looked at first, then the size."""
    return F.when(F.coalesce(name, F.lit("")) == "", NO_FILE).when(size > MAX_BYTES, TOO_LARGE).when(mime.isNull(), BAD_FORMAT)


def size_label(size: Column, mime: Column) -> Column:
    kind = F.upper(F.element_at(F.split(mime, "/"), -1))
    return F.concat(F.lit("Size: "), F.bround(size / 1024, 1).cast("string"), F.lit(" KB | Type: "), kind)
