"""Text, slug, number and image expressions on hand-made values."""

import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from weftbook.functions import images, numbers, slugs, text


def values(spark, rows, schema, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_either_takes_empty_for_missing(spark):
    rows = [(None, "t"), ("", "t"), ("x", "t")]
    assert values(spark, rows, "a string, b string", text.either(F.col("a"), F.col("b"))) == ["t", "t", "x"]


def test_dates(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-05 07:08:09' AS t UNION ALL SELECT NULL")
    found = df.select(
        text.date_text(F.col("t"), text.LONG_DATE),
        text.date_text(F.col("t"), text.SHORT_DATE),
        text.date_text(F.col("t"), text.DASH_TIME, "Not Published"),
        text.iso_text(F.col("t")),
    ).collect()
    assert tuple(found[0]) == ("05 March 2024", "05 Mar 2024", "05-03-2024 07:08", "2024-03-05T07:08:09")
    assert tuple(found[1]) == ("", "", "Not Published", None)


def test_iso_keeps_six_digits_of_a_fraction(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-05 07:08:09.1200' AS t")
    assert df.select(text.iso_text(F.col("t"))).first()[0] == "2024-03-05T07:08:09.120000"


def test_word_cut(spark):
    spaced = ("abcd " * 40)[:156]
    rows = [("x" * 155,), (spaced,), ("x" * 200,)]
    kept = spaced[:147].rsplit(" ", 1)[0] + "..."
    assert values(spark, rows, "a string", text.word_cut(F.col("a"))) == ["x" * 155, kept, "x" * 147 + "..."]


def test_small_texts(spark):
    rows = [("one\ntwo", "dRAFT")]
    found = values(
        spark, rows, "a string, b string",
        text.line_breaks(F.col("a")), text.capitalised(F.col("b")), text.head(F.col("b"), 2, "..."),
        text.link("https://h//", "news", F.col("b")),
    )
    assert found == [("one<br>two", "Draft", "dR...", "https://h/news/dRAFT")]


@pytest.mark.parametrize(
    "title, expected",
    [
        ("Fabric & Consumption", "fabric--consumption"),
        ("A/B test.", "a_b-test"),
        ("  Polo  Shirt ", "--polo--shirt-"),
        ("é", "e"),
        ("தமிழ்", ""),
        ("ﬁne ½", "fine-12"),
    ],
)
def test_slug(spark, title, expected):
    assert values(spark, [(title,)], "t string", slugs.slug_of(F.col("t"))) == [expected]


def test_ascii_of_every_character(spark):
    codes = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    texts = [(n, "".join(f"{chr(c)}x" for c in codes[n:n + 997])) for n in range(0, len(codes), 997)]
    df = spark.createDataFrame(texts, "n int, t string").select("n", slugs.plain_ascii(F.col("t")).alias("a"))
    found = {row.n: row.a for row in df.collect()}
    assert found == {n: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for n, t in texts}


def test_ascii_keeps_order_among_marks_and_needs_no_python(spark):
    rows = [("e\u0316\u0301a\u0301\u0316\u01c6",), (None,), ("",), ("\ud55c\uae00 \u216b\u2075",), ("\U0001d400\u2474\U0001f130",)]
    df = spark.createDataFrame(rows, "t string").select(slugs.plain_ascii(F.col("t")).alias("a"))
    assert [r.a for r in df.collect()] == ["eadz", None, "", " XII5", "A(1)A"]
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_given_slug_wins(spark):
    rows = [("Title", "My Slug/1"), ("Title", ""), ("Title", None)]
    found = values(spark, rows, "t string, s string", slugs.slug_of(F.col("t"), F.col("s")))
    assert found == ["my_slug_1", "title", "title"]


def test_read_numbers(spark):
    rows = [(v,) for v in ("12abc", " -1.5e2x", ".5", "abc", "", None, "7.", "1e", "Infinity")]
    found = values(spark, rows, "v string", numbers.read_number(F.col("v")))
    assert found == [12.0, -150.0, 0.5, None, None, None, 7.0, 1.0, float("inf")]
    assert values(spark, rows[:2], "v string", numbers.read_whole(F.col("v"))) == [12.0, -1.0]


def test_or_default(spark):
    rows = [(None,), (0.0,), (float("nan"),), (-0.0,), (3.0,)]
    assert values(spark, rows, "v double", numbers.or_default(F.col("v"), 100.0)) == [100.0] * 4 + [3.0]


@pytest.mark.parametrize(
    "value, digits, expected",
    [
        (1.005, 2, "1.00"),
        (0.125, 2, "0.13"),
        (2.5, 0, "3"),
        (2.675, 2, "2.67"),
        (-0.125, 2, "-0.13"),
        (-0.0, 2, "0.00"),
        (1234567.0, 1, "1234567.0"),
        (0.5, 0, "1"),
    ],
)
def test_fixed_text(spark, value, digits, expected):
    assert values(spark, [(value,)], "v double", numbers.fixed_text(F.col("v"), digits)) == [expected]


def test_image_kinds(spark):
    heads = [
        b"\x89PNG\r\n\x1a\n1234", b"\xff\xd8\xff\xe0abcdefgh", b"GIF87a123456", b"GIF89a123456",
        b"RIFF1234WEBP", b"RIFF1234WAVE", b"<svg><svg/>.", b"", None,
    ]
    found = values(spark, [(h,) for h in heads], "h binary", images.mime_type(F.col("h")))
    assert found == ["image/png", "image/jpeg", "image/gif", "image/gif", "image/webp", None, None, None, None]


def test_image_refusal_and_label(spark):
    rows = [(5242880, "image/png"), (5242881, "image/png"), (5242881, None), (10, None), (256, "image/webp")]
    found = values(
        spark, rows, "n bigint, m string",
        images.refusal(F.col("n"), F.col("m"), F.lit("f")), images.size_label(F.col("n"), F.col("m")), images.extension(F.col("m")),
    )
    assert [f[0] for f in found] == [None, images.TOO_LARGE, images.TOO_LARGE, images.BAD_FORMAT, None]
    assert found[0][1] == "Size: 5120.0 KB | Type: PNG"
    assert found[4][1:] == ("Size: 0.2 KB | Type: WEBP", ".webp")
