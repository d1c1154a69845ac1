"""Section 2.5: aggregations and calendar resampling."""

from pyspark.sql import functions as F

from ..functions.nullsafe import flag, rounded
from ..operators import features, resample as S
from ..operators import splits
from ..sources import tables as t
from . import query, view
from .joins import MON
from .scans import named_reports
from .views import sround

WEEK = MON.format(d="d")


def _r(df, keys, cols):
    return df.select(*keys, *[rounded(c).alias(c) for c in cols])


@query("resample_ohlcv_weekly", f"""
 select symbol, {WEEK} as week, {sround('arg_min(open,d)')} open, {sround('max(high)', 9)} high, {sround('min(low)', 9)} low,
  {sround('arg_max(close,d)')} as close, sum(volume) volume from bars group by 1,2""")
def resample_ohlcv_weekly(spark, sf):
    out = S.to_weeks(t.bars(spark, sf), ["symbol"], "d", S.MARKET_WEEKLY, complete=True, week="week")
    return out.select("symbol", "week", *[rounded(c, 9).alias(c) for c in ("open", "high", "low", "close", "volume")])


@query("resample_weather_weekly", f"""
 select region, {WEEK} as week, {sround('avg(temp_max)')} temp_max, {sround('avg(temp_min)')} temp_min, {sround('avg(et0)')} et0,
  {sround('avg(vpd_max)')} vpd_max, {sround('sum(precip)')} precip from weather group by 1,2""")
def resample_weather_weekly(spark, sf):
    out = S.to_weeks(t.weather(spark, sf), ["region"], "d", S.WEATHER_WEEKLY, complete=True, week="week")
    return _r(out, ["region", "week"], ["temp_max", "temp_min", "et0", "vpd_max", "precip"])


view("weekend", f"""
 select region, {WEEK} d, avg(temp_max) wt, sum(precip) wp, avg(et0) we from weather where isodow(d) in (6,7) group by 1,2""")
LAST = "last_value({c} ignore nulls) over (partition by region order by d rows between unbounded preceding and current row)"


@query("resample_weekend", f"""
 select region, d, {sround(LAST.format(c='wt'))} weekend_temp_max, {sround(LAST.format(c='wp'))} weekend_precip_sum, {sround(LAST.format(c='we'))} weekend_et0
 from weather left join weekend using (region, d)""")
def resample_weekend(spark, sf):
    from ..plans.weather import weekend_features

    out = weekend_features(t.weather(spark, sf), ["region"])
    return _r(out, ["region", "d"], ["weekend_temp_max", "weekend_precip_sum", "weekend_et0"])


@query("resample_flags_weekly", f"""
 with w as (select region, {WEEK} d, max((precip=0)::int) is_dry, max((temp_max>30)::int) is_hot from weather group by 1,2),
 e as (select region, min(d) lo, max(d) hi from w group by 1), s as (select region, cast(unnest(generate_series(lo,hi,interval 7 day)) as date) d from e)
 select region, d, coalesce(is_dry,0) is_dry, coalesce(is_hot,0) is_hot from s left join w using (region, d)""")
def resample_flags_weekly(spark, sf):
    from ..plans.calendars import weekly_flags

    f = features.day_flags(t.weather(spark, sf)).select("region", "d", F.col("dry_day").alias("is_dry"), F.col("hot_day").alias("is_hot"))
    return weekly_flags(f, ["region"], "d", ["is_dry", "is_hot"])


@query("resample_last_weekly", f"select {WEEK} as week, {sround('arg_max(close,d)')} as close from fx group by 1")
def resample_last_weekly(spark, sf):
    return _r(S.to_weeks(t.fx(spark, sf), [], "d", {"close": "last"}, week="week"), ["week"], ["close"])


@query("resample_mean_weekly", f"select symbol, {WEEK} as week, {sround('avg(close)', 9)} as close, {sround('avg(volume)')} volume from bars group by 1,2")
def resample_mean_weekly(spark, sf):
    out = S.to_weeks(t.bars(spark, sf), ["symbol"], "d", {"close": "mean", "volume": "mean"}, week="week")
    return out.select("symbol", "week", rounded("close", 9).alias("close"), rounded("volume").alias("volume"))


@query("region_backbone", f"select d, {sround('avg(temp_max)')} temp_max, {sround('avg(precip)')} precip from weather group by 1")
def region_backbone(spark, sf):
    return _r(S.regions_to_crop(t.weather(spark, sf), ["d"], ["temp_max", "precip"]), ["d"], ["temp_max", "precip"])


NAMES = ["planting_pct", "condition_good_pct", "condition_excellent_pct", "condition_poor_pct", "condition_very_poor_pct", "harvested_pct"]
view("report_wide", "select week_ending, state, " + ", ".join(f"max(case when measure='{n}' then v end) {n}" for n in NAMES) + " from report_named group by 1,2")


def report_wide(spark, sf):
    return S.pivot_first(named_reports(spark, sf), ["week_ending", "state"], "measure", "v", NAMES, "v")


@query("pivot_measures", "select * from report_wide")
def pivot_measures(spark, sf):
    return report_wide(spark, sf)


@query("combine_measures", """
 select week_ending, state, coalesce(condition_good_pct,0)+coalesce(condition_excellent_pct,0) condition_ge_pct,
  coalesce(condition_poor_pct,0)+coalesce(condition_very_poor_pct,0) condition_pvp_pct from report_wide""")
def combine_measures(spark, sf):
    from ..plans.reports import CONDITION_PAIRS

    out = S.combine_pairs(report_wide(spark, sf), CONDITION_PAIRS)
    return out.select("week_ending", "state", "condition_ge_pct", "condition_pvp_pct")


ATTRS = ["Production", "Arabica Production", "Robusta Production", "Ending Stocks", "Total Supply"]
view("psd", """
 select l_suppkey symbol, cast(year(l_shipdate) as int) market_year, case l_linenumber when 1 then 'Production' when 2 then 'Arabica Production'
  when 3 then 'Robusta Production' when 4 then 'Ending Stocks' else 'Total Supply' end attribute, sum(l_quantity) v from lineitem group by 1,2,3""")
view("psd_wide", "select symbol, market_year, " + ", ".join(
    f"max(case when attribute='{a}' then v end)/1000 {n}" for a, n in zip(ATTRS, ["production", "arabica", "robusta", "ending_stocks", "total_supply"])) + " from psd group by 1,2")


def psd(spark, sf):
    n = F.col("l_linenumber")
    name = F.when(n == 1, ATTRS[0]).when(n == 2, ATTRS[1]).when(n == 3, ATTRS[2]).when(n == 4, ATTRS[3]).otherwise(ATTRS[4])
    li = t.read(spark, sf, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("symbol"), F.year("l_shipdate").alias("market_year"), name.alias("attribute")).agg(F.sum("l_quantity").alias("v"))


def psd_wide(spark, sf):
    from ..plans.reports import attributes_wide

    return attributes_wide(psd(spark, sf), ["symbol", "market_year"], "attribute", "v")


@query("pivot_attributes", "select symbol, market_year, production, arabica, robusta, ending_stocks, total_supply from psd_wide")
def pivot_attributes(spark, sf):
    return psd_wide(spark, sf).select("symbol", "market_year", "production", "arabica", "robusta", "ending_stocks", "total_supply")


view("psd_ratios", """
 select a.*, case when p.production>0 then coalesce((a.production-p.production)/p.production*100,0) else 0 end change_pct,
  case when a.production>0 then coalesce(a.arabica/a.production*100,0) else 0 end arabica_pct,
  case when a.production>0 then coalesce(a.robusta/a.production*100,0) else 0 end robusta_pct,
  case when a.total_supply>0 then coalesce(a.ending_stocks/a.total_supply*100,0) else 0 end stock_to_use_pct
 from psd_wide a left join psd_wide p on a.symbol=p.symbol and a.market_year=p.market_year+1""")
RATIOS = ["change_pct", "arabica_pct", "robusta_pct", "stock_to_use_pct"]


@query("supply_ratios", "select symbol, market_year, " + ", ".join(f"{sround(c)} {c}" for c in RATIOS) + " from psd_ratios")
def supply_ratios(spark, sf):
    return _r(S.supply_ratios(psd_wide(spark, sf), ["symbol"], "market_year"), ["symbol", "market_year"], RATIOS)


def _split(spark, sf):
    return splits.chrono_split(t.returns(spark, sf).select("tag", "d", "r"), ["tag"], "d", 7)


@query("split_stats", f"select tag, split, count(*) n, cast(sum((r>0.025e0)::int) as bigint) positives, {sround('avg((r>0.025e0)::int)')} base_rate from tag_split group by 1,2")
def split_stats(spark, sf):
    from ..plans.dashboard import split_stats as stats

    return stats(_split(spark, sf).withColumn("target_binary", flag(F.col("r") > t.THETA)), ["tag"])


@query("class_distribution", f"""
 with c as (select tag, split, case when r>0.025e0 then 2 when r< -0.025e0 then 0 else 1 end y, count(*) n from tag_split group by 1,2,3)
 select tag, split, y, n, {sround('n/sum(n) over (partition by tag, split)')} pct from c""")
def class_distribution(spark, sf):
    from ..plans.dashboard import class_shares

    cls = F.when(F.col("r") > t.THETA, 2).when(F.col("r") < -t.THETA, 0).otherwise(1)
    return class_shares(_split(spark, sf).withColumn("y", cls), ["tag", "split"], "y")


DIST = {
    "flat_pct": "avg((abs(r)<=0.025e0)::int)", "pos_pct": "avg((r>0.025e0)::int)", "neg_pct": "avg((r< -0.025e0)::int)", "mean": "avg(r)",
    "std": "stddev_pop(r)", "median": "quantile_cont(r,0.5)", "p5": "quantile_cont(r,0.05)", "p95": "quantile_cont(r,0.95)",
}


@query("zero_inflation_stats", "select split, count(*) n, " + ", ".join(f"{sround(e)} {c}" for c, e in DIST.items()) + " from tag_split group by 1")
def zero_inflation_stats(spark, sf):
    return _r(S.distribution(_split(spark, sf), ["split"], "r", t.THETA), ["split", "n"], list(DIST))


@query("fixed_histogram", f"""
 with e as (select i, i*0.01e0+(-0.3e0) lo, (i+1)*0.01e0+(-0.3e0) hi from range(60) t(i)), s as (select distinct split from tag_split)
 select split, cast(i as int) bin, {sround('(lo+hi)/2')} center, (select count(*) from tag_split x where x.split=s.split and x.r>=lo and (x.r<hi or (i=59 and x.r<=0.3e0))) n from s cross join e""")
def fixed_histogram(spark, sf):
    out = S.fixed_histogram(_split(spark, sf), ["split"], "r", -0.3, 0.3, 60)
    return out.select("split", "bin", rounded("center").alias("center"), "n")


@query("distinct_first", "select l_partkey, l_orderkey, l_linenumber, l_quantity from (select *, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_quantity) q from lineitem) where q=1")
def distinct_first(spark, sf):
    li = t.read(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return S.first_per_key(li, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_quantity"])


