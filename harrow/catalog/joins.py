"""Section 2.4: joins."""

from pyspark.sql import functions as F

from ..functions.nullsafe import rounded
from ..operators import joins as J
from ..operators import resample, splits
from ..sources import tables as t
from . import query, view
from .scans import named_reports
from .views import sround

MON = "cast(date_trunc('week', {d} + 6) as date)"
view("fx_week", f"select {MON.format(d='d')} d, arg_max(close,d) usd_close from fx group by 1")


def fx_week(spark, sf):
    w = resample.to_weeks(t.fx(spark, sf).select("d", "close"), [], "d", {"close": "last"})
    return w.withColumnRenamed("close", "usd_close")


def _bars(spark, sf):
    return t.bars(spark, sf).select("symbol", "d", "close")


def _out(df, *cols):
    return df.select("symbol", "d", *[rounded(c, 9).alias(c) for c in cols])


@query("join_left_date", f"select symbol, b.d, {sround('close', 9)} as close, {sround('usd_close', 9)} usd_close from bars b left join fx_week using (d)")
def join_left_date(spark, sf):
    return _out(J.left_on(_bars(spark, sf), [fx_week(spark, sf)], ["d"]), "close", "usd_close")


CARRY = "last_value(usd_close ignore nulls) over (partition by symbol order by d rows between unbounded preceding and current row)"


@query("join_exact_then_carry", f"select symbol, d, {sround(CARRY, 9)} usd_close from bars left join fx_week using (d)")
def join_exact_then_carry(spark, sf):
    return _out(J.exact_then_carry(_bars(spark, sf), fx_week(spark, sf), ["symbol"], "d"), "usd_close")


@query("join_asof_backward", f"select symbol, b.d, {sround('f.usd_close', 9)} usd_close from bars b asof left join fx_week f on b.d>=f.d")
def join_asof_backward(spark, sf):
    return _out(J.asof_backward_shared(_bars(spark, sf), fx_week(spark, sf), "d", ["usd_close"]), "usd_close")


@query("join_asof_backward_keyed", f"""
 select a.symbol, a.d, {sround('b.volume', 9)} volume from bars a asof left join (select * from bars where volume>=40) b on a.symbol=b.symbol and a.d>=b.d""")
def join_asof_backward_keyed(spark, sf):
    b = t.bars(spark, sf)
    big = b.filter(F.col("volume") >= 40).select("symbol", "d", "volume")
    return _out(J.asof_backward(b.select("symbol", "d"), big, ["symbol"], "d", ["volume"]), "volume")


def lagging_models(spark, sf):
    """Models 2..4 lack the first rows of a tag, like models that need a packed window."""
    return t.predictions(spark, sf).filter(F.col("rn") >= 10 * (F.col("model") - 1))


view("preds_lagging", "select * from preds where rn>=10*(model-1)")


@query("join_inner_models", """
 select a.tag, a.d, a.y_true, a.p m1, b.p m2, c.p m3, e.p m4 from preds_lagging a
 join preds_lagging b on b.model=2 and a.tag=b.tag and a.d=b.d join preds_lagging c on c.model=3 and a.tag=c.tag and a.d=c.d
 join preds_lagging e on e.model=4 and a.tag=e.tag and a.d=e.d where a.model=1""")
def join_inner_models(spark, sf):
    return J.models_wide(lagging_models(spark, sf), ["tag", "d"], "model", [1, 2, 3, 4], "p", ["y_true"])


@query("join_pred_returns", f"select model, p.tag, p.d, p, {sround('r.r')} r from (select tag, d, model, p from preds) p join rets r using (tag,d)")
def join_pred_returns(spark, sf):
    p = t.predictions(spark, sf).select("tag", "d", "model", "p")
    return p.join(t.returns(spark, sf).select("tag", "d", "r"), ["tag", "d"]).select("model", "tag", "d", "p", rounded("r").alias("r"))


def _legs(spark, sf):
    p = lagging_models(spark, sf)
    pick = lambda m, c, name: p.filter(F.col("model") == m).select("tag", "d", F.col(c).alias(name))
    return pick(1, "p_up", "p_up"), pick(2, "p_down", "p_down"), pick(3, "y_hat", "single")


@query("join_align_hurdle", f"""
 select r.tag, r.d, {sround('u.p_up')} p_up, {sround('coalesce(w.p_down,greatest(1-u.p_up,0))')} p_down, {sround('s.y_hat')} single
 from rets r join preds_lagging u on u.model=1 and r.tag=u.tag and r.d=u.d join preds_lagging w on w.model=2 and r.tag=w.tag and r.d=w.d
 left join preds_lagging s on s.model=3 and r.tag=s.tag and r.d=s.d""")
def join_align_hurdle(spark, sf):
    test = t.returns(spark, sf).select("tag", "d")
    out = J.align_hurdle(test, *_legs(spark, sf), on=["tag", "d"])
    return out.select("tag", "d", *[rounded(c).alias(c) for c in ("p_up", "p_down", "single")])


@query("join_align_hurdle_counts", f"""
 select r.tag, count(*) n_test, count(u.p) n_up, count(case when u.p is not null then w.p end) n_aligned,
  {sround('(count(u.p)-count(case when u.p is not null then w.p end))/greatest(count(u.p),1)')} dropped
 from rets r left join preds_lagging u on u.model=1 and r.tag=u.tag and r.d=u.d left join preds_lagging w on w.model=2 and r.tag=w.tag and r.d=w.d group by 1""")
def join_align_hurdle_counts(spark, sf):
    up, down, _ = _legs(spark, sf)
    out = J.align_counts(t.returns(spark, sf), up, down, ["tag"], ["tag", "d"])
    return out.withColumn("dropped", rounded("dropped"))


TAIL = "row_number() over (partition by tag order by {o} desc)"


@query("join_tail_position", f"""
 select a.tag, b.d, a.p, {sround('b.r')} r from (select tag, p, {TAIL.format(o='rn')} e from preds_lagging where model=4) a
 join (select tag, d, r, {TAIL.format(o='d')} e from rets) b using (tag, e)""")
def join_tail_position(spark, sf):
    left = lagging_models(spark, sf).filter(F.col("model") == 4).select("tag", "rn", "p")
    right = t.returns(spark, sf).select("tag", "d", "r")
    out = J.tail_position(left, right, ["tag"], "rn", "d")
    return out.select("tag", "d", "p", rounded("r").alias("r"))


@query("join_attach_window_date", f"""
 select a.tag, b.d, a.p from (select tag, p, {TAIL.format(o='rn')} e from preds_lagging where model=2) a
 join (select tag, d, {TAIL.format(o='d')} e from (select *, row_number() over (partition by tag order by d) q from rets) where q>=14) b using (tag, e)""")
def join_attach_window_date(spark, sf):
    from ..operators.packing import metadata_rows

    left = lagging_models(spark, sf).filter(F.col("model") == 2).select("tag", "rn", "p")
    meta = metadata_rows(t.returns(spark, sf).select("tag", "d"), ["tag"], "d", 14)
    return J.tail_position(left, meta, ["tag"], "rn", "d").select("tag", "d", "p")


@query("join_state_week", """
 select a.week_ending, a.measure, a.v, b.v iowa_v from report_named a left join report_named b
 on a.week_ending=b.week_ending and a.measure=b.measure and b.state='IOWA' where a.state='US TOTAL'""")
def join_state_week(spark, sf):
    r = named_reports(spark, sf)
    us = r.filter(F.col("state") == "US TOTAL").select("week_ending", "measure", "v")
    iowa = r.filter(F.col("state") == "IOWA").select("week_ending", "measure", F.col("v").alias("iowa_v"))
    return us.join(iowa, ["week_ending", "measure"], "left")


view("crop_year", "select l_suppkey symbol, cast(year(l_shipdate) as int) y, sum(l_quantity) production from lineitem group by 1,2")


def crop_year(spark, sf):
    li = t.read(spark, sf, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("symbol"), F.year("l_shipdate").alias("y")).agg(F.sum("l_quantity").alias("production"))


@query("join_previous_year", "select a.symbol, a.y, a.production, b.production previous from crop_year a left join crop_year b on a.symbol=b.symbol and a.y=b.y+1")
def join_previous_year(spark, sf):
    return J.previous_year(crop_year(spark, sf), ["symbol"], "y", "production", "previous")


@query("cross_grid", f"""
 select model, cost, count(*) n, {sround('avg(r-cost)')} mean_net from preds cross join (select unnest([0e0,0.0005e0,0.001e0,0.002e0,0.003e0,0.005e0]) as cost) group by 1,2""")
def cross_grid(spark, sf):
    from ..operators.backtest import COSTS

    g = J.cross_grid(t.predictions(spark, sf).select("model", "r"), "cost", COSTS)
    return g.groupBy("model", "cost").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(F.col("r") - F.col("cost"))).alias("mean_net"))


view("tag_split", """
 select * from (select tag, d, r, rn0, n, case when rn0<floor(n*0.7e0)-7 then 'train' when rn0>=floor(n*0.7e0) and rn0<floor(n*0.8e0)-7 then 'val'
  when rn0>=floor(n*0.8e0) then 'test' end split from (select tag, d, r, row_number() over (partition by tag order by d)-1 rn0,
  count(*) over (partition by tag) n from rets)) where split is not null""")
OVERLAP = """
 with f as (select {key} d, max((split='train')::int) a, max((split='val')::int) b, max((split='test')::int) c from tag_split group by all)
 select {key} cast(sum(a*b) as bigint) train_val, cast(sum(b*c) as bigint) val_test, cast(sum(a*c) as bigint) train_test from f {grp}"""


@query("split_overlap_check", OVERLAP.format(key="", grp=""))
def split_overlap_check(spark, sf):
    """Splits pooled over all tags, so that dates are shared."""
    s = splits.chrono_split(t.returns(spark, sf).select("tag", "d"), ["tag"], "d", 7)
    return J.shared_dates(s, [], "d", "split")


