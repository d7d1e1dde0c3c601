"""Number texts, number reading and slugs against plain Python on many values."""

import re
import unicodedata
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftbook.functions.numbers import fixed_text, read_number
from weftbook.functions.slugs import slug_of

few = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

amounts = st.one_of(
    st.floats(-1e9, 1e9, allow_nan=False),
    st.integers(-(10**6), 10**6).map(lambda n: n / 8),
    st.integers(-(10**6), 10**6).map(lambda n: n / 1000),
    st.integers(-(10**6), 10**6).map(lambda n: n / 64),
)


def as_a_browser_prints(x: float, digits: int) -> str:
    if x == 0:
        x = 0.0
    size = Decimal(abs(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)
    return ("-" if x < 0 else "") + f"{size:f}"


@few
@given(st.lists(amounts, min_size=300, max_size=300))
def test_fixed_text(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for digits in (0, 1, 2, 3):
        found = [r[0] for r in df.select(fixed_text(F.col("x"), digits)).collect()]
        assert found == [as_a_browser_prints(x, digits) for x in xs]


NUMBER = re.compile(r"\s*([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))", re.ASCII)


@few
@given(st.lists(st.text("0123456789.eE+- x", max_size=12), min_size=200, max_size=200))
def test_read_number(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in df.select(read_number(F.col("t"))).collect()]
    matches = [NUMBER.match(t) for t in texts]
    assert found == [float(m.group(1)) if m else None for m in matches]


def safe(name: str) -> str:
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().replace("/", " ")
    return re.sub(r"[^A-Za-z0-9_.-]", "", "_".join(plain.split())).strip("._")


@few
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=("Cs", "Cc")), max_size=25), min_size=200, max_size=200))
def test_slug(spark, titles):
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    found = [r[0] for r in df.select(slug_of(F.col("t"))).collect()]
    assert found == [safe(t.lower().replace(" ", "-")).lower() for t in titles]
