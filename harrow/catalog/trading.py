"""Section 2.13: backtests on the long prediction table. Model 4 stands for the stacked ensemble."""

from pyspark.sql import functions as F

from ..functions.nullsafe import rounded
from ..operators import backtest as B
from ..operators import metrics as M
from ..operators import splits
from ..sources import tables as t
from . import query, view
from .evaluation import with_split
from .views import sround

KEYS = ["tag", "model"]
view("strided", """
 select * from (select *, row_number() over (partition by tag, model order by d) q from preds) where (q-1)%7=0""")


def _r(df, keys, cols):
    return df.select(*keys, *[rounded(c).alias(c) for c in cols])


def strided(spark, sf):
    return splits.stride(t.predictions(spark, sf), KEYS, "d", 7)



def shorts():
    return F.col("tag") % 2 == 1


LS = "case when p_up::float>0.33e0 then 1 when p_down::float>0.33e0 and tag%2=1 then -1 else 0 end"
view("ls_trades", f"select *, {LS} s, {LS}*r sr from strided")


def ls_trades(spark, sf):
    return strided(spark, sf).withColumn("signal", B.long_short_signal("p_up", "p_down", F.lit(B.LEVEL_DAILY), shorts()))


view("split_preds", "select p.*, s.split from preds p join (select tag, d, split from tag_split where split is not null) s using (tag, d)")
view("f1_val", """
 select tag, model, thr, coalesce(2e0*count(*) filter (where y_true=1 and p>=thr)/nullif(count(*) filter (where p>=thr)+sum(y_true),0),0) f1
 from split_preds cross join (select i*0.01e0+0.05e0 thr from range(90) t(i)) where split='val' group by 1,2,3""")
view("thr_trades", """
 select a.*, thr, (p>=thr)::int s, (p>=thr)::int*r sr from
 (select * from (select *, row_number() over (partition by tag, model order by d) q from split_preds where split='test') where (q-1)%7=0) a join (select tag, model, thr from
 (select *, row_number() over (partition by tag, model order by f1 desc, thr) k from f1_val) where k=1) using (tag, model)""")


def tuned(spark, sf):
    """Test rows with the threshold that does best on the validation rows of the same key."""
    rows = with_split(spark, sf)
    thr = M.best_f1_threshold(rows.filter(F.col("split") == "val"), KEYS, "y_true", "p").select(*KEYS, "threshold")
    return rows.filter(F.col("split") == "test").join(thr, KEYS)


@query("signal_threshold", "select tag, model, d, s signal from thr_trades")
def signal_threshold(spark, sf):
    out = splits.stride(tuned(spark, sf), KEYS, "d", 7).withColumn("signal", B.threshold_signal("p", F.col("threshold")))
    return out.select(*KEYS, "d", "signal")


@query("signal_long_short", "select tag, model, d, s signal from ls_trades")
def signal_long_short(spark, sf):
    return ls_trades(spark, sf).select(*KEYS, "d", "signal")


@query("signal_percentile", """
 with c as (select *, (y_hat::float)::double yf from strided), q as (select tag, model, quantile_cont(yf,0.75) cut from c group by 1,2)
 select tag, model, d, (yf>cut)::int signal from c join q using (tag, model)""")
def signal_percentile(spark, sf):
    return B.percentile_signal(strided(spark, sf), KEYS, "y_hat").select(*KEYS, "d", "signal")


@query("signal_class_map", "select tag, model, d, case cls when 2 then 1 when 0 then -1 else 0 end signal from strided")
def signal_class_map(spark, sf):
    return strided(spark, sf).select(*KEYS, "d", B.class_signal("cls").alias("signal"))


@query("strategy_returns", f"select tag, model, d, s signal, {sround('sr')} strat from ls_trades")
def strategy_returns(spark, sf):
    return ls_trades(spark, sf).select(*KEYS, "d", "signal", rounded(B.strategy_return()).alias("strat"))


SHARPE = "(avg({c})-0.04e0/52)/nullif(stddev_pop({c}),0)*sqrt(52e0)"


@query("sharpe_ratio", f"select tag, model, {sround('case when count(*)>=2 then ' + SHARPE.format(c='sr') + ' end')} sharpe from ls_trades group by 1,2")
def sharpe_ratio(spark, sf):
    out = ls_trades(spark, sf).withColumn("strat", B.strategy_return()).groupBy(*KEYS)
    return out.agg(rounded(B.sharpe("strat")).alias("sharpe"))


view("ls_equity", "select *, product(1+sr) over (partition by tag, model order by d) eq, product(1+r) over (partition by tag, model order by d) bh from ls_trades")
view("ls_peak", "select *, eq/max(eq) over (partition by tag, model order by d)-1 dd from ls_equity")


@query("max_drawdown", f"select tag, model, {sround('min(dd)')} max_drawdown from ls_peak group by 1,2")
def max_drawdown(spark, sf):
    return _r(B.summarize(ls_trades(spark, sf), KEYS), KEYS, ["max_drawdown"])


@query("win_rate", f"select tag, model, {sround('avg((sr>0)::int) filter (where s<>0)')} win_rate from ls_trades group by 1,2")
def win_rate(spark, sf):
    out = ls_trades(spark, sf).withColumn("strat", B.strategy_return()).groupBy(*KEYS)
    return out.agg(rounded(B.win_rate("signal", "strat")).alias("win_rate"))


@query("total_return", f"""
 select tag, model, count(*) n_test, count(*) filter (where s<>0) n_trades, {sround('count(*) filter (where s<>0)/count(*)')} trade_rate,
  {sround('product(1+sr)-1')} total_return, {sround('product(1+r)-1', 2)} bh_total_return from ls_trades group by 1,2""")
def total_return(spark, sf):
    out = B.summarize(ls_trades(spark, sf), KEYS)
    return out.select(*KEYS, "n_test", "n_trades", rounded("trade_rate").alias("trade_rate"),
                      rounded("total_return").alias("total_return"), rounded("bh_total_return", 2).alias("bh_total_return"))


def _summary_sql(src: str, keys: str = "tag, model") -> str:
    w = f"over (partition by {keys} order by d)"
    return f"""select {keys}, count(*) n_test, count(*) filter (where s<>0) n_trades, {sround('count(*) filter (where s<>0)/count(*)')} trade_rate,
 {sround(SHARPE.format(c='sr'))} sharpe, {sround('min(eq/pk-1)')} max_drawdown, {sround('avg((sr>0)::int) filter (where s<>0)')} win_rate,
 {sround('(product(1+sr)-1)/(1+abs(product(1+sr)-1))')} return_squashed, {sround(SHARPE.format(c='r'))} bh_sharpe
 from (select *, max(eq) {w} pk from (select *, product(1+sr) {w} eq from {src})) group by {keys}"""


COLS = ["trade_rate", "sharpe", "max_drawdown", "win_rate", "bh_sharpe"]


def squashed():
    """Total return on (-1, 1): noisy test prices compound to any size."""
    r = F.col("total_return")
    return rounded(r / (1 + F.abs(r))).alias("return_squashed")


def _summary_out(df, keys):
    return df.select(*keys, "n_test", "n_trades", *[rounded(c).alias(c) for c in COLS], squashed())


@query("backtest_compare", _summary_sql("thr_trades"))
def backtest_compare(spark, sf):
    """Binary engine: threshold per (tag, model) from validation, trades on test."""
    out = B.compare(tuned(spark, sf), KEYS, B.threshold_signal("p", F.col("threshold")))
    return _summary_out(out, KEYS)


@query("backtest_compare_multiclass", _summary_sql("ls_trades"))
def backtest_compare_multiclass(spark, sf):
    signal = B.long_short_signal("p_up", "p_down", F.lit(B.LEVEL_DAILY), shorts())
    return _summary_out(B.compare(t.predictions(spark, sf), KEYS, signal), KEYS)


view("pct_trades", """
 with c as (select *, (y_hat::float)::double yf from strided), q as (select tag, model, quantile_cont(yf,0.75) cut from c group by 1,2)
 select c.*, (yf>cut)::int s, (yf>cut)::int*r sr from c join q using (tag, model)""")


@query("backtest_compare_regression", _summary_sql("pct_trades"))
def backtest_compare_regression(spark, sf):
    trades = B.percentile_signal(strided(spark, sf), KEYS, "y_hat")
    return _summary_out(B.summarize(trades, KEYS), KEYS)


@query("equity_curve", f"""
 select tag, d, {sround('ln(1e-9+product(1+s*r) over w)', 5)} model_log, {sround('ln(1e-9+product(1+r) over w)', 5)} bh_log
 from (select *, case cls when 2 then 1 when 0 then -1 else 0 end s from preds where model=4) window w as (partition by tag order by d)""")
def equity_curve(spark, sf):
    rows = t.predictions(spark, sf).filter(F.col("model") == 4)
    out = B.equity_curve(rows, ["tag"], B.class_signal("cls"))
    log = lambda c, n: F.round(F.ln(F.col(c) + 1e-9), 5).alias(n)
    return out.select("tag", "d", log("model_equity", "model_log"), log("bh_equity", "bh_log"))


view("year_trades", "select *, unnest([cast(year(d) as varchar),'ALL']) yr from ls_trades")
view("year_rows", """
 select tag, model, yr, count(*) n, count(*) filter (where s<>0) n_trades,
  case when count(*) filter (where s<>0)>0 then (avg(sr)-0.02e0/52)/nullif(stddev_pop(sr),0)*sqrt(52e0) end sharpe,
  case when count(*) filter (where s<>0)>0 then min(eq/pk-1) end mdd, avg((sr>0)::int) filter (where s<>0) winrate
 from (select *, max(eq) over (partition by tag, model, yr order by d) pk from (select *, product(1+sr) over (partition by tag, model, yr order by d) eq from year_trades))
 group by 1,2,3 having count(*)>=5""")


@query("walkforward_by_year", f"select tag, model, yr \"year\", n, n_trades, {sround('sharpe')} sharpe, {sround('mdd')} mdd, {sround('winrate')} winrate from year_rows")
def walkforward_by_year(spark, sf):
    return _r(B.by_year(ls_trades(spark, sf), KEYS), [*KEYS, "year", "n", "n_trades"], ["sharpe", "mdd", "winrate"])


@query("viability_gate", """
 select *, case when good_years*3>=years*2 then 'VIABLE' when good_years*3>=years then 'MARGINAL' else 'WEAK' end verdict from
 (select tag, model, count(*) filter (where sharpe>0) good_years, count(*) as years from year_rows where yr<>'ALL' group by 1,2)""")
def viability_gate(spark, sf):
    return B.viability(B.by_year(ls_trades(spark, sf), KEYS), KEYS)


DRAWS = 10_000
view("boot_src", "select tag, sr, row_number() over (partition by tag order by d)-1 j, count(*) over (partition by tag) n from ls_trades where model=4")
view("boot_draws", f"""
 select tag, b, j, (((b*7919+j*104729)%1000003)*((b*31+j*17+7)%999983)+b*j)%2147483647%n idx from boot_src cross join (select i as b from range(1,{DRAWS + 1}) t(i))""")


def _boot(spark, sf):
    return ls_trades(spark, sf).filter(F.col("model") == 4).withColumn("strat", B.strategy_return())


@query("bootstrap_draws", f"select a.tag, b, count(*) n, {sround('sum(sr)')} total from boot_draws a join boot_src s on a.tag=s.tag and a.idx=s.j group by 1,2")
def bootstrap_draws(spark, sf):
    out = B.bootstrap_draws(_boot(spark, sf), ["tag"], "strat", DRAWS)
    long = out.select("tag", "n", F.posexplode("total").alias("b", "total"))
    return long.select("tag", (F.col("b") + 1).cast("long").alias("b"), "n", rounded("total").alias("total"))


BOOT = {"ci_lower": "quantile_cont(sh,0.025)", "median_bs": "quantile_cont(sh,0.5)", "ci_upper": "quantile_cont(sh,0.975)",
        "p_positive": "avg((sh>0)::int)", "p_above_1": "avg((sh>1)::int)"}


@query("bootstrap_sharpe_ci", f"""
 with d as (select a.tag, b, {SHARPE.format(c='sr')} sh from boot_draws a join boot_src s on a.tag=s.tag and a.idx=s.j group by 1,2),
 q as (select tag, {', '.join(f'{e} {c}' for c, e in BOOT.items())}, count(*) n_boot from d where sh is not null group by 1),
 o as (select tag, {SHARPE.format(c='sr')} sharpe_obs from boot_src group by 1)
 select tag, n_boot, {', '.join(f'{sround(c)} {c}' for c in ['sharpe_obs', *BOOT])} from o join q using (tag)""")
def bootstrap_sharpe_ci(spark, sf):
    out = B.bootstrap_sharpe(_boot(spark, sf), ["tag"], draws=DRAWS)
    return _r(out, ["tag", "n_boot"], ["sharpe_obs", *BOOT])


@query("cost_sensitivity", f"""
 with c as (select tag, model, d, s, sr-(case when s<>0 then cost else 0 end) nr, cost from ls_trades cross join (select unnest([0e0,0.0005e0,0.001e0,0.002e0,0.003e0,0.005e0]) as cost)),
 g as (select tag, model, cost, count(*) filter (where s<>0) n_trades, {SHARPE.format(c='nr')} sharpe, product(1+nr)-1 tr, min(eq/pk-1) mdd, avg((nr>0)::int) filter (where s<>0) wr
  from (select *, max(eq) over (partition by tag, model, cost order by d) pk from (select *, product(1+nr) over (partition by tag, model, cost order by d) eq from c)) group by 1,2,3)
 select tag, model, cost, n_trades, {sround('sharpe')} sharpe, {sround('tr/(1+abs(tr))')} return_squashed, {sround('mdd')} mdd, {sround('wr')} win_rate,
  case when cost=0 then 'Baseline' when sharpe>=1.5e0 then 'Robust' when sharpe>=0.8e0 then 'Acceptable' when sharpe>=0 then 'Degraded' else 'Negative' end verdict from g""")
def cost_sensitivity(spark, sf):
    out = B.cost_sensitivity(ls_trades(spark, sf), KEYS)
    return out.select(*KEYS, "cost", "n_trades", rounded("sharpe").alias("sharpe"),
                      squashed(), rounded("mdd").alias("mdd"),
                      rounded("win_rate").alias("win_rate"), "verdict")
