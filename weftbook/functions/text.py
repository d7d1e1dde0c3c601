"""Text expressions: fallbacks, cuts, dates and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date patterns of the pages (fixed values).
LONG_DATE = "dd MMMM yyyy"
SHORT_DATE = "dd MMM yyyy"
DASH_DATE = "dd-MM-yyyy"
DASH_TIME = "dd-MM-yyyy HH:mm"


def either(value: Column, fallback: Column | str) -> Column:
    """``value`` unless it is NULL or empty; then ``fallback``."""
    other = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.coalesce(F.nullif(value, F.lit("")), other)


def shown(name: str) -> Column:
    """A column as the pages print it: a missing value reads 'None'."""
    return F.coalesce(F.col(name), F.lit("None"))


def date_text(moment: Column, pattern: str, missing: str | None = "") -> Column:
    """A date as text; ``missing`` stands for no date."""
    return F.coalesce(F.date_format(moment, pattern), F.lit(missing))


def iso_text(moment: Column) -> Column:
    """ISO 8601 text; a fraction appears, with six digits, only if it is not zero."""
    return F.regexp_replace(
        F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", ""
    )


def head(value: Column, size: int, ending: str = "") -> Column:
    """The first ``size`` characters, with ``ending`` always added."""
    return F.concat(F.substring(value, 1, size), F.lit(ending)) if ending else F.substring(value, 1, size)


def word_cut(value: Column, size: int = 150, leeway: int = 5, ending: str = "...") -> Column:
    """Shorten to whole words: texts up to ``size + leeway`` characters stay as they are."""
    kept = F.regexp_replace(F.substring(value, 1, size - len(ending)), r" [^ ]*$", "")
    return F.when(F.char_length(value) <= size + leeway, value).otherwise(F.concat(kept, F.lit(ending)))


def line_breaks(value: Column) -> Column:
    return F.replace(value, F.lit("\n"), F.lit("<br>"))


def capitalised(value: Column) -> Column:
    """First character upper case, the others lower case."""
    return F.concat(F.upper(F.substring(value, 1, 1)), F.lower(F.substring(value, 2, 2_147_483_647)))


def link(base: str, section: str, slug: Column) -> Column:
    """Address of an item; ``base`` may end in slashes."""
    return F.concat(F.lit(f"{base.rstrip('/')}/{section}/"), slug)
