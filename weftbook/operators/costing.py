"""Garment cost sheets over a table of styles.

Every sheet reads inputs as doubles (NULL and NaN both mean "not given") and adds
``reject_reason``, the first failed check or NULL, its numbers, unrounded, and their texts,
rounded as a browser prints them.  Rejected rows stay, with NULL results.  The functions
named ..._numbers leave the texts out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import exceeds, fixed_text, or_default, whole

# Reasons, limits, factors and class names of the sheets.
BAD_SMV = "Please enter a valid SMV value greater than 0."
BAD_WEIGHT = "Please enter a valid weight in grams."
BAD_SWATCH = "Please enter valid length and width in cm."
BAD_SEAM = "Please enter a valid positive seam length."
BAD_BODY = "Please enter valid positive values for Chest, Body Length and GSM."
BAD_WASTAGE = "Wastage must be between 0% and 100%."
BAD_RATES = "Rates cannot be negative."
BAD_LOSS = "Fabric wastage must be between 0% and 50% (exclusive)."
BAD_LINE = "Operators count, daily target output, and expected efficiency must be positive numbers."
BAD_WAGES = "Wages and overheads cannot be negative."
BAD_EFFICIENCY = "Efficiency cannot exceed 150%."
BAD_COSTS = "Cost parameters cannot be negative numbers."
BAD_MARGIN = "Margin percentage must be between -50% and 200%."

THREAD_FACTORS = {"401": 4.5, "504": 14.0}
THREAD_DEFAULT = 2.5
CUTTER_AREA = 100.0
SEAM_ALLOWANCE, HEM_ALLOWANCE = 2.0, 4.0
GSM_CLASSES = (
    (150.0, "Light Weight (e.g. T-shirt, Voile, Chiffon)"),
    (250.0, "Medium Weight (e.g. Polo pique, Linen, Oxford)"),
)
GSM_HEAVIEST = "Heavy Weight (e.g. Sweatshirt fleece, Denim, Canvas)"

REASON = "reject_reason"


def _any(checks: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, checks)


def _cleaned(styles: DataFrame, *names: str, default: float = 0.0) -> tuple[DataFrame, list[Column]]:
    """Inputs with their default filled in, as columns of their own: each is worked out once
    however often a sheet uses it, and the compiled code stays small."""
    clean = {f"__{name}": or_default(F.col(name), default) for name in names}
    return styles.withColumns(clean), [F.col(name) for name in clean]


def _refuse(styles: DataFrame, reason: str, *checks: tuple[Column, str]) -> DataFrame:
    """Add the reason of the first failed check."""
    return styles.withColumn(reason, F.coalesce(*[F.when(failed, why) for failed, why in checks]))


def _passed(reason: str, value: Column) -> Column:
    """A result that rests on inputs: NULL for rejected rows.  Results made of other results
    need no guard, NULL carries on."""
    return F.when(F.col(reason).isNull(), value)


def sam_numbers(styles: DataFrame, reason: str = REASON) -> DataFrame:
    """Standard minutes with allowance, and pieces per operator and hour.

    An allowance of -100 gives zero minutes and an unlimited target: NULL, flagged, and
    ``target_sign`` tells its direction (an efficiency below zero turns it round).
    """
    c = F.col
    checked = _refuse(styles, reason, (~exceeds(c("smv"), 0.0), BAD_SMV))
    sam = c("smv") * (1 + or_default(c("allowance"), 0.0) / 100)
    per_hour = F.try_divide(F.lit(60.0), c("sam")) * (or_default(c("efficiency"), 100.0) / 100)
    return checked.withColumn("sam", _passed(reason, sam)).withColumns(
        {
            "target_per_hour": per_hour,
            "infinite_target": c("sam") == 0,
            "target_sign": F.signum(or_default(c("efficiency"), 100.0)),
        }
    )


def sam_sheet(styles: DataFrame) -> DataFrame:
    c = F.col
    unlimited = F.when(c("target_sign") < 0, "-Infinity").otherwise("Infinity")
    target = F.when(c("infinite_target"), unlimited).otherwise(fixed_text(c("target_per_hour"), 1))
    return sam_numbers(styles).withColumns(
        {
            "sam_text": F.concat(fixed_text(c("sam"), 3), F.lit(" mins")),
            "target_text": F.concat(target, F.lit(" pcs/hr")),
        }
    )


def gsm_numbers(styles: DataFrame, reason: str = REASON) -> DataFrame:
    """Weight per square metre of a swatch, and its class."""
    c = F.col
    rectangular = F.coalesce(c("swatch_type") == "rectangular", F.lit(False))
    flat = ~exceeds(c("swatch_length"), 0.0) | ~exceeds(c("swatch_width"), 0.0)
    checked = _refuse(
        styles, reason, (~exceeds(c("swatch_weight"), 0.0), BAD_WEIGHT), (rectangular & flat, BAD_SWATCH)
    )
    area = F.when(rectangular, c("swatch_length") * c("swatch_width")).otherwise(CUTTER_AREA)
    per_area = F.try_divide(c("swatch_weight") * 10000, c("area_cm2"))
    gsm = F.when(rectangular, per_area).otherwise(c("swatch_weight") * 100)
    kind = F.when(c("gsm_value").isNotNull(), GSM_HEAVIEST)
    for limit, name in reversed(GSM_CLASSES):
        kind = F.when(c("gsm_value") <= limit, name).otherwise(kind)
    return (
        checked.withColumn("area_cm2", _passed(reason, area))
        .withColumn("gsm_value", _passed(reason, gsm))
        .withColumn("gsm_class", kind)
    )


def gsm_sheet(styles: DataFrame) -> DataFrame:
    c = F.col
    return gsm_numbers(styles).withColumns(
        {
            "gsm_text": F.concat(fixed_text(c("gsm_value"), 1), F.lit(" g/m²")),
            "area_text": F.concat(fixed_text(c("area_cm2"), 1), F.lit(" cm²")),
        }
    )


def thread_numbers(styles: DataFrame, reason: str = REASON) -> DataFrame:
    """Thread per garment from seam length and stitch class."""
    c = F.col
    styles, (wastage,) = _cleaned(styles, "wastage")
    checked = _refuse(
        styles,
        reason,
        (~exceeds(c("seam_length"), 0.0), BAD_SEAM),
        ((wastage < 0) | (wastage > 100), BAD_WASTAGE),
    )
    factor = F.lit(THREAD_DEFAULT)
    for stitch, value in THREAD_FACTORS.items():
        factor = F.when(c("stitch_class") == stitch, value).otherwise(factor)
    return (
        checked.withColumn("factor", _passed(reason, factor))
        .withColumn("raw_thread", c("seam_length") * c("factor"))
        .withColumn("total_thread", c("raw_thread") * (1 + wastage / 100))
        .drop(wastage)
    )


def thread_sheet(styles: DataFrame) -> DataFrame:
    c = F.col
    return thread_numbers(styles).withColumns(
        {
            "factor_text": F.concat(fixed_text(c("factor"), 1), F.lit("x")),
            "raw_thread_text": F.concat(fixed_text(c("raw_thread"), 2), F.lit(" m")),
            "thread_text": F.concat(fixed_text(c("total_thread"), 2), F.lit(" meters")),
        }
    )


def fabric_weight_numbers(styles: DataFrame, reason: str = REASON) -> DataFrame:
    """Fabric per garment in grams and per dozen in kilograms."""
    c = F.col
    styles, (wastage,) = _cleaned(styles, "wastage")
    checked = _refuse(
        styles,
        reason,
        (_any([~exceeds(c(name), 0.0) for name in ("chest", "body_length", "gsm")]), BAD_BODY),
        ((wastage < 0) | (wastage > 100), BAD_WASTAGE),
    )
    length, width = c("body_length") + HEM_ALLOWANCE, c("chest") + SEAM_ALLOWANCE
    return (
        checked.withColumn("raw_weight", _passed(reason, (length * width * 2 * c("gsm")) / 10000))
        .withColumn("total_weight", c("raw_weight") * (1 + wastage / 100))
        .withColumn("dozen_kg", (c("total_weight") * 12) / 1000)
        .drop(wastage)
    )


def fabric_weight_sheet(styles: DataFrame) -> DataFrame:
    c = F.col
    return fabric_weight_numbers(styles).withColumns(
        {
            "raw_weight_text": F.concat(fixed_text(c("raw_weight"), 1), F.lit(" g")),
            "weight_text": F.concat(fixed_text(c("total_weight"), 1), F.lit(" grams")),
            "dozen_text": F.concat(fixed_text(c("dozen_kg"), 2), F.lit(" kg")),
        }
    )


def fabric_price_numbers(styles: DataFrame, reason: str = REASON) -> DataFrame:
    """Price of finished fabric per kilogram, with the loss in processing."""
    c = F.col
    styles, (*rates, wastage) = _cleaned(styles, "yarn", "knit", "dye", "fabric_wastage")
    checked = _refuse(
        styles,
        reason,
        (_any([rate < 0 for rate in rates]), BAD_RATES),
        ((wastage < 0) | (wastage >= 50), BAD_LOSS),
    )
    return (
        checked.withColumn("raw_price", _passed(reason, rates[0] + rates[1] + rates[2]))
        .withColumn("fabric_price", F.try_divide(c("raw_price"), 1 - wastage / 100))
        .withColumn("loss_price", c("fabric_price") - c("raw_price"))
        .drop(*rates, wastage)
    )


def fabric_price_sheet(styles: DataFrame) -> DataFrame:
    c = F.col
    return fabric_price_numbers(styles).withColumns(
        {
            "raw_price_text": fixed_text(c("raw_price"), 2),
            "loss_text": fixed_text(c("loss_price"), 2),
            "fabric_price_text": fixed_text(c("fabric_price"), 2),
        }
    )


def cm_numbers(styles: DataFrame, reason: str = REASON) -> DataFrame:
    """Cut and make cost of a garment from the day's cost of a line."""
    c = F.col
    inputs = ("operators", "wage", "overhead", "target", "line_efficiency")
    styles, (workers, wage, overhead, target, efficiency) = _cleaned(styles, *inputs)
    operators = whole(workers)
    checked = _refuse(
        styles,
        reason,
        ((operators <= 0) | (target <= 0) | (efficiency <= 0), BAD_LINE),
        ((wage < 0) | (overhead < 0), BAD_WAGES),
        (efficiency > 150, BAD_EFFICIENCY),
    )
    return checked.withColumns(
        {
            "day_cost": _passed(reason, overhead + operators * wage),
            "expected_output": _passed(reason, target * (efficiency / 100)),
        }
    ).withColumn("cm_cost", F.try_divide(c("day_cost"), c("expected_output"))).drop(
        workers, wage, overhead, target, efficiency
    )


def cm_sheet(styles: DataFrame) -> DataFrame:
    c = F.col
    return cm_numbers(styles).withColumns(
        {
            "day_text": fixed_text(c("day_cost"), 2),
            "output_text": F.concat(fixed_text(c("expected_output"), 0), F.lit(" pcs")),
            "cm_text": fixed_text(c("cm_cost"), 2),
        }
    )


def fob_numbers(styles: DataFrame, reason: str = REASON) -> DataFrame:
    """Export price from the parts of the cost and a margin."""
    c = F.col
    styles, (*parts, margin) = _cleaned(styles, "fabric", "cm", "trims", "accessories", "logistics", "margin")
    checked = _refuse(
        styles,
        reason,
        (_any([part < 0 for part in parts]), BAD_COSTS),
        ((margin < -50) | (margin > 200), BAD_MARGIN),
    )
    return (
        checked.withColumn("base_cost", _passed(reason, reduce(lambda a, b: a + b, parts)))
        .withColumn("fob", c("base_cost") * (1 + margin / 100))
        .withColumn("profit", c("fob") - c("base_cost"))
        .drop(*parts, margin)
    )


def fob_sheet(styles: DataFrame) -> DataFrame:
    c = F.col
    return fob_numbers(styles).withColumns(
        {
            "base_text": F.concat(F.lit("$"), fixed_text(c("base_cost"), 2)),
            "profit_text": F.concat(F.lit("$"), fixed_text(c("profit"), 2)),
            "fob_text": F.concat(F.lit("$"), fixed_text(c("fob"), 2)),
        }
    )


def cost_chain(styles: DataFrame) -> DataFrame:
    """Fabric weight, fabric price, cut and make, and export price of every style.

    The sheets follow each other in one pass over the rows.  ``reject_reason`` is that of
    the first sheet that refuses the style; only a style no sheet refuses has a price.
    """
    stages = ("__weight", "__price", "__line", "__fob")
    line = cm_numbers(fabric_price_numbers(fabric_weight_numbers(styles, stages[0]), stages[1]), stages[2])
    inputs = line.withColumns(
        {"fabric": F.col("total_weight") / 1000 * F.col("fabric_price"), "cm": F.col("cm_cost")}
    )
    priced = fob_numbers(inputs, stages[3]).withColumn(REASON, F.coalesce(*stages)).drop(*stages)
    return priced.withColumns({name: _passed(REASON, F.col(name)) for name in ("base_cost", "fob", "profit")})


def roll_up(sheets: DataFrame, group: str, amounts: list[str]) -> DataFrame:
    """Per group: styles, rejected styles, and sum and mean of the amounts.

    Amounts are summed as decimals, so totals do not depend on how rows are split; partial
    sums before the shuffle keep a very large group cheap.
    """
    exact = {name: F.col(name).cast("decimal(28,6)") for name in amounts}
    return sheets.groupBy(group).agg(
        F.count(F.lit(1)).alias("styles"),
        F.count(F.col(REASON)).alias("rejected"),
        *[F.sum(value).cast("double").alias(f"{name}_sum") for name, value in exact.items()],
        *[
            (F.sum(value).cast("double") / F.count(F.col(name))).alias(f"{name}_mean")
            for name, value in exact.items()
        ],
    )


def cost_sheet(styles: DataFrame, group: str = "group_id") -> DataFrame:
    return roll_up(cost_chain(styles), group, ["base_cost", "fob", "profit"])
