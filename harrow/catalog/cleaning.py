"""Section 2.3: anomaly removal and gap filling."""

from pyspark.sql import functions as F

from ..functions.calendar import release_date
from ..functions.nullsafe import rounded
from ..operators import clean
from ..sources import tables as t
from . import query, view
from .views import sround

W = "partition by sensor order by seq"
BACK15 = f"over ({W} rows between 14 preceding and current row)"
view("tick_spikes", f"""
 select *, coalesce(v < q1-0.47e0*(q3-q1) or v > q3+0.47e0*(q3-q1), false)::int v_spike
 from (select *, quantile_cont(v,0.25) {BACK15} q1, quantile_cont(v,0.75) {BACK15} q3 from ticks)""")


def _flags(spark, sf):
    return clean.iqr_outliers(t.ticks(spark, sf), ["sensor"], "seq", ["v"], k=0.47)


@query("miqr_spikes", "select sensor, seq, v_spike from tick_spikes")
def miqr_spikes(spark, sf):
    return _flags(spark, sf).select("sensor", "seq", "v_spike")


@query("sustained_run_guard", f"""
 select sensor, seq, v_spike, total run_rows, case when v_spike=1 and total<2 then null else v end kept
 from (select *, case when v_spike=1 then cast(sum(v_spike) over (partition by sensor, blk) as bigint) else 0 end total
  from (select *, sum(1-v_spike) over ({W}) blk from tick_spikes))""")
def sustained_run_guard(spark, sf):
    out = clean.run_totals(_flags(spark, sf), ["sensor"], "seq", ["v_spike"])
    kept = F.when((F.col("v_spike") == 1) & (F.col("v_spike_run") < 2), None).otherwise(F.col("v"))
    return out.select("sensor", "seq", "v_spike", F.col("v_spike_run").alias("run_rows"), kept.alias("kept"))


@query("flatline_detect", f"""
 select sensor, seq, coalesce(sum(flat) over ({W} rows between 3 preceding and current row)>=4,false)::int x_dead
 from (select *, (coalesce(stddev_samp(x) over ({W} rows between 4 preceding and current row),0)<12)::int flat from ticks)""")
def flatline_detect(spark, sf):
    """Readings are noisy, so the flat limit is raised to where some runs qualify."""
    from ..operators.ordered import over_rows

    layers = clean.dead_sensor_layers(["x"], eps=12.0)
    out = over_rows(t.ticks(spark, sf), ["sensor"], "seq", layers, before=9)
    return out.select("sensor", "seq", "x_dead")


SPIKE_SQL = """
 abs((close-p)/p)>{lim} and abs((nx-close)/close)>{lim} and (close-p)*(nx-close)<0"""
view("bar_spikes", f"""
 select *, coalesce({SPIKE_SQL.format(lim='0.06e0')},false)::int close_spike
 from (select *, lag(close) over (partition by symbol order by d) p, lead(close) over (partition by symbol order by d) nx,
  row_number() over (partition by symbol order by d) pos from bars)""")
view("bar_filled", """
 select symbol, d, pos, close_spike, coalesce(c0, bv+(av-bv)/(ap-bp)*(pos-bp), bv) as close from (
 select *, last_value(c0 ignore nulls) over w bv, last_value(case when c0 is not null then pos end ignore nulls) over w bp,
  first_value(c0 ignore nulls) over f av, first_value(case when c0 is not null then pos end ignore nulls) over f ap
 from (select *, case when close_spike=0 then close end c0 from bar_spikes)
 window w as (partition by symbol order by d rows between unbounded preceding and current row),
  f as (partition by symbol order by d rows between current row and unbounded following))""")


@query("acu_despike", f"select symbol, d, {sround('ln(close)', 8)} log_close from bar_filled")
def acu_despike(spark, sf):
    out = clean.despike(t.bars(spark, sf).select("symbol", "d", "close"), ["symbol"], "d", {"close": 0.06})
    return out.select("symbol", "d", rounded(F.ln("close"), 8).alias("log_close"))


@query("interpolate_linear", f"""
 with g as (select *, row_number() over ({W}) pos from ticks),
 n as (select *, last_value(x ignore nulls) over w bv, last_value(case when x is not null then pos end ignore nulls) over w bp,
  first_value(x ignore nulls) over f av, first_value(case when x is not null then pos end ignore nulls) over f ap from g
  window w as ({W} rows between unbounded preceding and current row), f as ({W} rows between current row and unbounded following))
 select sensor, seq, {sround('coalesce(x, bv+(av-bv)/(ap-bp)*(pos-bp), bv)')} x from n""")
def interpolate_linear(spark, sf):
    out = clean.interpolate(t.ticks(spark, sf), ["sensor"], "seq", ["x"])
    return out.select("sensor", "seq", rounded("x").alias("x"))


@query("forward_fill", f"select sensor, seq, last_value(x ignore nulls) over ({W} rows between unbounded preceding and current row) x from ticks")
def forward_fill(spark, sf):
    return clean.forward_fill(t.ticks(spark, sf), ["sensor"], "seq", ["x"]).select("sensor", "seq", "x")


@query("zero_fill", "select sensor, seq, coalesce(x,0) x from ticks")
def zero_fill(spark, sf):
    return clean.fill_constant(t.ticks(spark, sf), {"x": 0.0}).select("sensor", "seq", "x")


@query("constant_fill", "select sensor, seq, coalesce(x,50) x from ticks")
def constant_fill(spark, sf):
    return clean.fill_constant(t.ticks(spark, sf), {"x": 50.0}).select("sensor", "seq", "x")


@query("back_fill", f"select sensor, seq, first_value(x ignore nulls) over ({W} rows between current row and unbounded following) x from ticks")
def back_fill(spark, sf):
    return clean.back_fill(t.ticks(spark, sf), ["sensor"], "seq", ["x"]).select("sensor", "seq", "x")


@query("densify_daily", f"""
 with ends as (select symbol, min(d) lo, max(d) hi from bars group by 1),
 days as (select symbol, cast(unnest(generate_series(lo,hi,interval 1 day)) as date) d from ends)
 select symbol, d, {sround('last_value(close ignore nulls) over (partition by symbol order by d rows between unbounded preceding and current row)')} as close
 from days left join bars using (symbol,d)""")
def densify_daily(spark, sf):
    b = t.bars(spark, sf).select("symbol", "d", "close")
    return clean.densify_daily(b, ["symbol"], "d", ["close"]).select("symbol", "d", rounded("close").alias("close"))


@query("publication_lag", f"select cast(d + interval 1 month as date)+12 released, {sround('v')} v from macro_monthly")
def publication_lag(spark, sf):
    return t.macro_monthly(spark, sf).select(release_date("d").alias("released"), rounded("v").alias("v"))
