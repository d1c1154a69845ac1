"""Section 2.2: projections, filters, predicates."""

from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions.nullsafe import rounded
from ..operators import features
from ..sources import tables as t
from . import query
from .views import sround
from .scans import named_reports


@query("month_flags", "select orders.o_orderkey, cast(month(o_orderdate) in (9,10,11) as int) is_flowering, "
       "cast(month(o_orderdate) in (5,6,7,8) as int) is_harvest from orders")
def month_flags(spark, sf):
    o = t.read(spark, sf, "orders")
    return o.select("o_orderkey", *[C.in_months("o_orderdate", m).alias(n) for n, m in t.CROP_MONTHS["coffee"].items()])


@query("date_spine", "with e as (select min(d) lo, max(d) hi from fx) select cast(unnest(generate_series(lo,hi,interval 1 day)) as date) d from e")
def date_spine(spark, sf):
    return C.spine_of(t.fx(spark, sf).withColumn("s", F.lit(1)), ["s"], "d").select("d")


@query("weekend_filter", "select symbol, d, volume from bars where isodow(d) in (6,7)")
def weekend_filter(spark, sf):
    return t.bars(spark, sf).filter(C.is_weekend("d")).select("symbol", "d", "volume")


@query("threshold_day_flags", """
 select region, d, coalesce(temp_max>30,false)::int hot_day, coalesce(temp_max<10,false)::int cold_day, coalesce(precip=0,false)::int dry_day from weather""")
def threshold_day_flags(spark, sf):
    return features.day_flags(t.weather(spark, sf)).select("region", "d", "hot_day", "cold_day", "dry_day")


@query("ohlc_consistency", """
 select symbol, d, case when low is not null and close is not null then greatest(low,close) end high,
  case when high is not null and close is not null then least(high,close) end low from bars""")
def ohlc_consistency(spark, sf):
    swapped = t.bars(spark, sf).select("symbol", "d", "close", F.col("low").alias("high"), F.col("high").alias("low"))
    return features.ohlc_consistent(swapped).select("symbol", "d", "high", "low")


@query("currency_adjust", f"""
 select symbol, d, {sround('b.close*f.close')} currency_adjusted_close from bars b join fx f using (d)""")
def currency_adjust(spark, sf):
    f = t.fx(spark, sf).select("d", F.col("close").alias("usd_close"))
    out = t.bars(spark, sf).join(f, "d").withColumn("currency_adjusted_close", F.col("close") * F.col("usd_close"))
    return out.select("symbol", "d", rounded("currency_adjusted_close").alias("currency_adjusted_close"))


@query("prefix_columns", f"select d, {sround('close')} usd_close, high usd_high, low usd_low from fx")
def prefix_columns(spark, sf):
    from ..operators.joins import prefixed

    return prefixed(t.fx(spark, sf).withColumn("close", rounded("close")), "usd_", ["d"])


@query("drop_all_null_columns", "select sensor, seq, x from ticks")
def drop_all_null_columns(spark, sf):
    df = t.ticks(spark, sf).select("sensor", "seq", "x", F.when(F.col("v") < 0, F.col("v")).alias("broken"))
    return features.drop_all_null_columns(df)


@query("drop_incomplete_rows", "select sensor, seq, x, k from ticks where x is not null")
def drop_incomplete_rows(spark, sf):
    return t.ticks(spark, sf).select("sensor", "seq", "x", "k").na.drop(how="any")


@query("sanitize_features", "select seq, k::double k, coalesce(x,0) x, 0e0 missing_feature from ticks")
def sanitize_features(spark, sf):
    df = t.ticks(spark, sf).withColumn("x", F.when(F.col("x").isNull(), float("inf")).otherwise(F.col("x")))
    wanted = features.feature_columns(df.drop("v"), drop=["seq"]) + ["missing_feature"]
    return features.sanitize(df, wanted, keep=["seq"])


@query("drop_by_prefix", "select d from spine")
def drop_by_prefix(spark, sf):
    from ..operators.joins import prefixed

    return features.drop_by_prefix(prefixed(t.calendar(spark, sf, "corn"), "cal_", ["d"]), "cal_")


@query("state_filter", "select week_ending, state, measure, v from report_named where state in ('US TOTAL','IOWA')")
def state_filter(spark, sf):
    r = named_reports(spark, sf)
    return r.filter(F.col("state").isin("US TOTAL", "IOWA")).select("week_ending", "state", "measure", "v")


@query("subset_by_return", f"""
 select 'up' leg, tag, d, {sround('r')} magnitude from rets where r>0.025e0
 union all select 'down', tag, d, {sround('-r')} from rets where r< -0.025e0""")
def subset_by_return(spark, sf):
    from ..operators.models import hurdle_legs

    r = t.returns(spark, sf).withColumn("target_binary", (F.col("r") > t.THETA).cast("double"))
    return hurdle_legs(r, "r", t.THETA).select("leg", "tag", "d", rounded("magnitude").alias("magnitude"))


