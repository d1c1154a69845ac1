"""Section 2.8: scalar functions."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.calendar import to_day
from ..functions.nullsafe import rounded
from ..operators import labels
from ..plans import reports
from ..plans.calendars import cyclic_codes
from ..sources import tables as t
from . import query, view
from .views import sround


@query("cyclic_encode", "select o_orderkey, " + ", ".join(
    f"{sround(f'{f}(2*pi()*{e}/{n}e0)')} {f}_{name}" for f in ("sin", "cos") for name, e, n in (("month", "month(o_orderdate)", 12), ("week", "week(o_orderdate)", 52))) + " from orders")
def cyclic_encode(spark, sf):
    o = t.read(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return cyclic_codes(o).select("o_orderkey", *[rounded(c).alias(c) for c in ("sin_month", "sin_week", "cos_month", "cos_week")])


@query("sigmoid_label", f"select tag, d, {sround('1/(1+exp(-(r-0.025e0)/0.02e0))')} target_soft from rets")
def sigmoid_label(spark, sf):
    return t.returns(spark, sf).select("tag", "d", rounded(labels.soft("r", t.THETA)).alias("target_soft"))


@query("clip", f"select tag, d, {sround('greatest(least(r,0.3e0),-0.3e0)')} target_reg from rets")
def clip(spark, sf):
    return t.returns(spark, sf).select("tag", "d", rounded(labels.capped("r")).alias("target_reg"))


@query("regime_bucket", "select sensor, seq, case when x>0 and x<=15 then 0e0 when x>15 and x<=25 then 1e0 when x>25 and x<=999 then 2e0 end regime from ticks")
def regime_bucket(spark, sf):
    return t.ticks(spark, sf).select("sensor", "seq", S.bucket_of("x", [0, 15, 25, 999]).alias("regime"))


@query("class_argmax", "select tag, model, d, case when p_down>=p_flat and p_down>=p_up then 0 when p_flat>=p_up then 1 else 2 end hat from preds")
def class_argmax(spark, sf):
    return t.predictions(spark, sf).select("tag", "model", "d", S.argmax(["p_down", "p_flat", "p_up"]).alias("hat"))


def label_of(c="sensor"):
    """A report label per event type, one of them unknown."""
    return (
        F.when(F.col(c) == "view", "ahead_bullish").when(F.col(c) == "click", "delayed_bearish")
        .when(F.col(c) == "error", "very_delayed_very_bearish").when(F.col(c) == "purchase", "condition_improving").otherwise("meteor_strike")
    )


LABEL = "case sensor when 'view' then 'ahead_bullish' when 'click' then 'delayed_bearish' when 'error' then 'very_delayed_very_bearish' when 'purchase' then 'condition_improving' else 'meteor_strike' end"
view("labelled", f"select *, {LABEL} label from ticks")
CORN = "case label when 'ahead_bullish' then 2 when 'delayed_bearish' then -1 when 'very_delayed_very_bearish' then -2 when 'condition_improving' then 1 else 0 end"


@query("ordinal_encode", f"select sensor, seq, {CORN} code from labelled")
def ordinal_encode(spark, sf):
    return t.ticks(spark, sf).select("sensor", "seq", S.code_of(label_of(), S.CORN_SIGNALS, 0).alias("code"))


@query("signal_from_numbers", """
 select sensor, seq, case when g>=5 then 'ahead_bullish' when g<=-15 then 'very_delayed_very_bearish' when g<=-5 then 'delayed_bearish'
  when x>=30 then 'condition_deteriorating' when x<=10 then 'condition_improving' else 'on_track' end signal
 from (select *, case when k between 30 and 70 then k-50 end g from ticks)""")
def signal_from_numbers(spark, sf):
    gap = F.when(F.col("k").between(30, 70), F.col("k") - 50)
    return t.ticks(spark, sf).select("sensor", "seq", S.progress_signal(gap, F.col("x")).alias("signal"))


@query("signal_from_change", """
 select symbol, market_year, case when change_pct>=10 then 'bumper_crop_bullish' when change_pct>=3 then 'above_average'
  when change_pct<=-10 then 'crop_stress_bearish' when change_pct<=-3 then 'below_average' else 'on_track' end signal from psd_ratios""")
def signal_from_change(spark, sf):
    from ..operators.resample import supply_ratios
    from .resampling import psd_wide

    r = supply_ratios(psd_wide(spark, sf), ["symbol"], "market_year")
    return r.select("symbol", "market_year", S.production_signal(F.col("change_pct")).alias("signal"))


def corn_documents(spark, sf):
    """Extracted report text per event: some fenced, some broken, some with bad percentages."""
    k = F.col("k")
    national = F.to_json(F.struct((k + 10).alias("planting_pct"), k.alias("emerged_pct")))
    body = F.concat(
        F.lit('{"report_date":"2024-01-01","week_ending":"2024-01-07","national":'), national,
        F.lit(',"states":{"IOWA":{"planting_pct":'), k.cast("string"), F.lit('}},"notable_events":["'),
        F.when(k > 50, "severe drought in the north").otherwise("rain"), F.lit('"],"signal":"'), label_of(), F.lit('"}'))
    text = F.when(k < 10, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k < 13, F.substring(body, 1, 60)).otherwise(body)
    return t.ticks(spark, sf).select("seq", text.alias("text"))


@query("parse_extract_json", f"""
 select seq, not (k between 10 and 12) and k+10<=100 accepted, case when k between 10 and 12 then null else k+10 end planting_pct,
  case when k between 10 and 12 then 'on_track' when label='meteor_strike' then 'on_track' else label end signal from labelled""")
def parse_extract_json(spark, sf):
    r = reports.parse_corn(corn_documents(spark, sf), "text", ["seq"])
    # a truncated document keeps no field
    ok = F.col("national").isNotNull() & F.col("states").isNotNull()
    return r.select("seq", "accepted", F.when(ok, F.col("national.planting_pct")).alias("planting_pct"),
                    F.when(ok, F.col("signal")).otherwise("on_track").alias("signal"))


def coffee_documents(spark, sf):
    k = F.col("k")
    stage = F.when(k < 30, "flowering").when(k < 60, "harvest").when(k < 80, "hibernation")
    doc = F.struct(
        F.date_add(F.lit("2000-01-01").cast("date"), F.col("seq").cast("int")).cast("string").alias("report_date"),
        F.struct(stage.alias("stage"), k.alias("harvest_completion_pct"), (k / 10).alias("production_change_vs_last_year_pct")).alias("national"),
        F.create_map(F.lit("sul_de_minas"), F.struct(F.when(k < 50, "good").when(k < 70, "odd").alias("condition"))).alias("regions"),
        F.array(F.when(k >= 50, "long drought").otherwise("frost")).alias("weather_events"),
        label_of().alias("signal"))
    return t.ticks(spark, sf).select("seq", F.to_json(doc).alias("text"))


@query("event_flags", "select seq, (k<30)::int coffee_flowering_flag, (k>=50)::int coffee_drought_flag, case when k<30 then 1 when k<60 then 4 else 0 end coffee_stage_encoded, "
       "case when k<50 then 3 else 2 end coffee_sul_minas_condition from ticks")
def event_flags(spark, sf):
    r = reports.parse_coffee(coffee_documents(spark, sf), "text", ["seq"])
    out = reports.coffee_codes(r, ["seq"])
    return out.select("seq", "coffee_flowering_flag", "coffee_drought_flag", "coffee_stage_encoded", "coffee_sul_minas_condition")


@query("verdict_tiers", """
 select sensor, seq, case when k<15 then 'Baseline' when s>=1.5e0 then 'Robust' when s>=0.8e0 then 'Acceptable' when s>=0 then 'Degraded' else 'Negative' end cost_verdict,
  case when k*3>=100*2 then 'VIABLE' when k*3>=100 then 'MARGINAL' else 'WEAK' end gate_verdict from (select *, (v-20)/20 s from ticks)""")
def verdict_tiers(spark, sf):
    cost = F.when(F.col("k") < 15, 0.0).otherwise(0.001)
    return t.ticks(spark, sf).select("sensor", "seq", S.cost_verdict(cost, (F.col("v") - 20) / 20).alias("cost_verdict"),
                                     S.gate_verdict(F.col("k"), F.lit(100)).alias("gate_verdict"))


@query("date_normalize", """
 select o_orderkey, case o_orderstatus when 'O' then cast(o_orderdate as date) when 'F' then cast(o_orderdate as date)+1 end d from orders""")
def date_normalize(spark, sf):
    o = t.read(spark, sf, "orders")
    day = F.to_date("o_orderdate").cast("string")
    text = (
        F.when(F.col("o_orderstatus") == "O", F.concat(day, F.lit(" 00:00:00+00:00")))
        .when(F.col("o_orderstatus") == "F", F.concat(day, F.lit("T22:30:00-05:00"))).otherwise("not a date")
    )
    return o.select("o_orderkey", to_day(text).alias("d"))
