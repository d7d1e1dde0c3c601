"""Numbers as a browser reads and prints them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading number of a text: optional sign, digits with a point, exponent.
NUMBER_PREFIX = r"^[\s\u00A0\uFEFF]*([+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?))"


def read_number(value: Column) -> Column:
    """The number a text starts with; NULL (for "not a number") if there is none."""
    return F.nullif(F.regexp_extract(value, NUMBER_PREFIX, 1), F.lit("")).try_cast("double")


def read_whole(value: Column) -> Column:
    """Like ``read_number``, but only the digits before a point or exponent count."""
    digits = F.regexp_extract(value, r"^[\s\u00A0\uFEFF]*([+-]?[0-9]+)", 1)
    return F.nullif(digits, F.lit("")).try_cast("double")


def or_default(value: Column, default: float) -> Column:
    """The number, or ``default`` where it is missing, NaN or zero."""
    return F.when((value != 0) & ~F.isnan(value), value).otherwise(F.lit(float(default)))


def exceeds(value: Column, limit: float) -> Column:
    """Whether a number is given and above ``limit``; never NULL."""
    return F.when((value > limit) & ~F.isnan(value), True).otherwise(False)


def whole(value: Column) -> Column:
    """Cut towards zero."""
    return F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("double")


def fixed_text(value: Column, digits: int) -> Column:
    """Text with ``digits`` decimals, rounding the exact binary value, ties away from zero.

    ``format_number`` is exact but sends ties to the even digit.  A tie needs
    ``value * 2 ** (digits + 1)`` to be an odd whole number; such values are moved a
    little outwards first.
    """
    scaled = value * F.lit(float(2 ** (digits + 1)))
    tie = (F.abs(scaled) < F.lit(2.0**52)) & (F.abs(scaled % F.lit(2.0)) == 1.0)
    nudged = F.when(tie, value * F.lit(1.0 + 1e-12)).when(value == 0, F.lit(0.0)).otherwise(value)
    shape = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", nudged, F.lit(shape))
