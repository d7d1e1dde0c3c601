"""Cost sheets on hand-made styles, against plain Python."""

import pytest
from pyspark.sql import functions as F

from weftbook.operators import costing


def one(spark, sheet, **inputs):
    texts = ("swatch_type", "stitch_class")
    schema = ", ".join(f"{k} {'string' if k in texts else 'double'}" for k in inputs)
    row = tuple(v if k in texts or v is None else float(v) for k, v in inputs.items())
    return sheet(spark.createDataFrame([row], schema)).first()


def test_sam(spark):
    r = one(spark, costing.sam_sheet, smv=10, allowance=20, efficiency=0)
    assert (r.sam, r.target_per_hour, r.sam_text, r.target_text) == (12.0, 5.0, "12.000 mins", "5.0 pcs/hr")
    assert not r.infinite_target and r.reject_reason is None
    for smv in (0, -1, None, float("nan")):
        r = one(spark, costing.sam_sheet, smv=smv, allowance=20, efficiency=0)
        assert r.reject_reason == costing.BAD_SMV and r.sam is None and r.sam_text is None and r.target_text is None
    r = one(spark, costing.sam_sheet, smv=10, allowance=-100, efficiency=None)
    assert r.infinite_target and r.target_per_hour is None and r.target_text == "Infinity pcs/hr"


@pytest.mark.parametrize("weight, gsm, kind", [(1.5, 150, "Light"), (2.5, 250, "Medium"), (2.6, 260, "Heavy")])
def test_gsm_of_a_round_swatch(spark, weight, gsm, kind):
    r = one(spark, costing.gsm_sheet, swatch_weight=weight, swatch_type="circular", swatch_length=None, swatch_width=None)
    assert r.gsm_value == gsm and r.area_cm2 == 100 and r.gsm_class.startswith(kind)


def test_gsm_of_a_rectangle(spark):
    r = one(spark, costing.gsm_sheet, swatch_weight=2, swatch_type="rectangular", swatch_length=10, swatch_width=5)
    assert (r.area_cm2, r.gsm_value, r.area_text, r.gsm_text) == (50.0, 400.0, "50.0 cm²", "400.0 g/m²")
    r = one(spark, costing.gsm_sheet, swatch_weight=2, swatch_type="rectangular", swatch_length=10, swatch_width=None)
    assert r.reject_reason == costing.BAD_SWATCH and r.gsm_class is None
    r = one(spark, costing.gsm_sheet, swatch_weight=None, swatch_type="rectangular", swatch_length=0, swatch_width=0)
    assert r.reject_reason == costing.BAD_WEIGHT


@pytest.mark.parametrize("stitch, factor", [("301", 2.5), ("401", 4.5), ("504", 14.0), ("999", 2.5), (None, 2.5)])
def test_thread_factor(spark, stitch, factor):
    r = one(spark, costing.thread_sheet, seam_length=2, stitch_class=stitch, wastage=10)
    assert r.factor == factor and r.total_thread == 2 * factor * (1 + 10 / 100)


def test_thread(spark):
    r = one(spark, costing.thread_sheet, seam_length=2, stitch_class="504", wastage=10)
    assert (r.raw_thread, r.thread_text) == (28.0, "30.80 meters")
    assert one(spark, costing.thread_sheet, seam_length=2, stitch_class="504", wastage=101).reject_reason == costing.BAD_WASTAGE
    assert one(spark, costing.thread_sheet, seam_length=0, stitch_class="504", wastage=101).reject_reason == costing.BAD_SEAM
    assert one(spark, costing.thread_sheet, seam_length=2, stitch_class="301", wastage=None).total_thread == 5.0


def test_fabric_weight(spark):
    r = one(spark, costing.fabric_weight_sheet, chest=50, body_length=70, gsm=180, wastage=10)
    assert r.raw_weight == pytest.approx(138.528) and r.total_weight == pytest.approx(152.3808)
    assert r.dozen_kg == pytest.approx(1.8285696) and r.dozen_text == "1.83 kg"
    r = one(spark, costing.fabric_weight_sheet, chest=50, body_length=None, gsm=180, wastage=-1)
    assert r.reject_reason == costing.BAD_BODY


def test_fabric_price(spark):
    r = one(spark, costing.fabric_price_sheet, yarn=3, knit=1, dye=1, fabric_wastage=0)
    assert (r.fabric_price, r.loss_price, r.fabric_price_text) == (5.0, 0.0, "5.00")
    assert one(spark, costing.fabric_price_sheet, yarn=3, knit=1, dye=1, fabric_wastage=50).reject_reason == costing.BAD_LOSS
    assert one(spark, costing.fabric_price_sheet, yarn=-3, knit=1, dye=1, fabric_wastage=50).reject_reason == costing.BAD_RATES


def line(spark, **changed):
    return one(spark, costing.cm_sheet, **{**dict(operators=30, wage=500, overhead=5000, target=1000, line_efficiency=80), **changed})


def test_cut_and_make(spark):
    r = line(spark)
    assert (r.day_cost, r.expected_output, r.cm_cost, r.output_text) == (20000.0, 800.0, 25.0, "800 pcs")
    assert line(spark, operators=30.9).day_cost == 20000.0  # a count is cut to a whole number
    assert line(spark, operators=0.5).reject_reason == costing.BAD_LINE
    assert line(spark, line_efficiency=151).reject_reason == costing.BAD_EFFICIENCY
    assert line(spark, wage=-1).reject_reason == costing.BAD_WAGES
    assert line(spark, wage=-1, target=None).reject_reason == costing.BAD_LINE


def price(spark, **changed):
    parts = dict(fabric=2, cm=1, trims=0.5, accessories=0.3, logistics=0.2, margin=10)
    return one(spark, costing.fob_sheet, **{**parts, **changed})


def test_fob(spark):
    r = price(spark)
    assert r.base_cost == pytest.approx(4) and r.fob == pytest.approx(4.4) and r.profit == pytest.approx(0.4)
    assert (r.base_text, r.fob_text, r.profit_text) == ("$4.00", "$4.40", "$0.40")
    assert price(spark, margin=-51).reject_reason == costing.BAD_MARGIN
    assert price(spark, trims=-1, margin=-51).reject_reason == costing.BAD_COSTS
    assert price(spark, margin=None).profit == 0.0


def test_sheet_adds_up_over_a_large_group(spark, cat):
    """One group holds a third of the styles; sums are the same however rows are split."""
    styles = cat.styles.withColumn("group_id", F.when(F.col("group_id") % 3 == 0, 0).otherwise(F.col("group_id")))
    few = {r.group_id: r for r in costing.cost_sheet(styles.coalesce(1)).collect()}
    many = {r.group_id: r for r in costing.cost_sheet(styles.repartition(16)).collect()}
    assert few == many
    chain = costing.cost_chain(styles).where("group_id = 0").collect()
    assert few[0].styles == len(chain) and few[0].rejected == sum(r.reject_reason is not None for r in chain)
    assert few[0].fob_sum == pytest.approx(sum(r.fob for r in chain if r.fob is not None), abs=1e-3)


def test_chain_has_prices_only_for_accepted_styles(cat):
    chain = costing.cost_chain(cat.styles)
    assert chain.where("reject_reason IS NOT NULL AND fob IS NOT NULL").count() == 0
    assert chain.where("reject_reason IS NULL AND fob IS NULL").count() == 0
    assert chain.where("reject_reason IS NULL").count() > 0
    assert not [c for c in chain.columns if c.startswith("__")]
