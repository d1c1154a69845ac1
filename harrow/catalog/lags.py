"""Section 2.10: lag scan of weekly volume against the forward weekly return, per symbol."""

from pyspark.sql import functions as F

from ..functions.nullsafe import rounded
from ..operators import labels
from ..operators import lagscan as G
from ..operators.ordered import over_rows
from ..operators.resample import to_weeks
from ..sources import tables as t
from ..sources.sinks import cut
from . import query, view
from .views import sround

KEYS = ["symbol"]
WEEK = "cast(date_trunc('week', d + 6) as date)"
view("scan_week", f"""
 select symbol, d, volume x, lead(close) over (partition by symbol order by d)/close-1 y from
 (select symbol, {WEEK} d, sum(volume) volume, arg_max(close,d) as close from bars group by 1,2)""")
view("scan_pairs", """
 select * from (select symbol, x, y, row_number() over (partition by symbol order by d) i, count(*) over (partition by symbol) n from scan_week where x is not null and y is not null) where n>=72""")
view("scan_static", """
 select a.symbol, b.i-a.i lag, corr(a.x,b.y) r, count(*) pairs from scan_pairs a join scan_pairs b on a.symbol=b.symbol and b.i-a.i between 1 and 52 group by 1,2 having count(*)>=20""")
DRAWS = 300
view("scan_null", f"""
 with l as (select symbol, x, y, i, n, lag from scan_pairs cross join (select unnest(range(1,53)) lag)),
 sx as (select symbol, lag, b, x, row_number() over (partition by symbol, lag, b order by (((b*7919+(i-1)*104729)%1000003)*((b*31+(i-1)*17+7)%999983)+b*(i-1))%2147483647, i) pos
  from l cross join (select unnest(range(1,{DRAWS + 1})) b) where i<=n-lag),
 sy as (select symbol, lag, i-lag pos, y from l where i>lag)
 select symbol, lag, b, corr(x,y) r from sx join sy using (symbol, lag, pos) group by 1,2,3""")
view("scan_p", f"select s.symbol, s.lag, s.r, s.pairs, coalesce(sum((abs(u.r)>=abs(s.r))::int),0)/{DRAWS}e0 p from scan_static s join scan_null u on s.symbol=u.symbol and s.lag=u.lag group by 1,2,3,4")


def weeks(spark, sf):
    w = to_weeks(t.bars(spark, sf).select("symbol", "d", "close", "volume"), KEYS, "d", {"close": "last", "volume": "sum"})
    w = over_rows(w, KEYS, "d", [labels.forward_return("close", 1, "y")], 0, 1)
    return w.select("symbol", "d", F.col("volume").alias("x"), "y")


def stored_weeks(spark, sf):
    """The weeks as a table for several readers, laid out by symbol in partitions that grow with it."""
    w = cut(weeks(spark, sf), "scan_weeks")
    return w.repartition(t.layout_parts(spark, 2 * w.count()), *KEYS)


def static(spark, sf):
    return G.static_scan(weeks(spark, sf), KEYS, "d", "x", "y")


@query("ccf_static", f"select symbol, lag, {sround('r')} r, pairs from scan_static")
def ccf_static(spark, sf):
    out = static(spark, sf)
    return out.select("symbol", F.col("lag").cast("long").alias("lag"), rounded("r").alias("r"), "pairs")


def with_p(spark, sf, w):
    s = cut(G.static_scan(w, KEYS, "d", "x", "y"), "scan_static")
    null = G.null_scan(w, KEYS, "d", "x", "y", draws=DRAWS, seen=s)
    return G.permutation_p(s, null, KEYS, DRAWS)


@query("ccf_permutation_p", f"select symbol, lag, {sround('r')} r, {sround('p')} p from scan_p")
def ccf_permutation_p(spark, sf):
    out = with_p(spark, sf, stored_weeks(spark, sf))
    return out.select("symbol", F.col("lag").cast("long").alias("lag"), rounded("r").alias("r"), rounded("p").alias("p"))


def rolling_sql(lags: str) -> str:
    return f"""
 with s as (select symbol, x, y, row_number() over (partition by symbol order by d)-1 i, count(*) over (partition by symbol) n from scan_week),
 p as (select a.symbol, a.i, b.i-a.i lag, a.n, a.x, b.y from s a join s b on a.symbol=b.symbol and b.i-a.i between 1 and 37 where a.x is not null and b.y is not null),
 w as (select p.*, st*4 st from p join ({lags}) k on p.symbol=k.symbol and p.lag=k.lag join (select unnest(range(0,5000)) st) q on st*4<=i and i<st*4+52-p.lag and st*4<n-52-p.lag)
 select symbol, lag, st start, corr(x,y) r, count(*) pairs from w group by 1,2,3 having count(*)>=15"""


view("scan_rolling", rolling_sql("select distinct symbol, unnest(range(1,38)) lag from scan_week"))


@query("ccf_rolling", f"select symbol, lag, start, {sround('r')} r, pairs from scan_rolling")
def ccf_rolling(spark, sf):
    w = weeks(spark, sf)
    lags = w.select("symbol").distinct().withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(37))))
    out = G.rolling_scan(w, KEYS, "d", "x", "y", lags)
    return out.select("symbol", F.col("lag").cast("long").alias("lag"), "start", rounded("r").alias("r"), "pairs")


def p_sql(r: str, n: str) -> str:
    """Two-sided p by the same distribution in closed form: terms through gamma functions."""
    even = f"abs({r})*list_sum(list_transform(range(0,(({n}-2)//2)::bigint), lambda k: exp(lgamma(k+0.5e0)-lgamma(0.5e0)-lgamma(k+1e0))*pow(1-{r}*{r},k)))"
    odd = f"2/pi()*(asin(abs({r}))+abs({r})*coalesce(list_sum(list_transform(range(0,(({n}-3)//2)::bigint), lambda k: sqrt(pi())/2*exp(lgamma(k+1e0)-lgamma(k+1.5e0))*pow(1-{r}*{r},k+0.5e0))),0))"
    return f"greatest(1-(case when {n}%2=0 then {even} else {odd} end),0)"


@query("pearson_p_value", f"select symbol, lag, {sround(p_sql('r', 'pairs'))} p from scan_static")
def pearson_p_value(spark, sf):
    out = static(spark, sf)
    return out.select("symbol", F.col("lag").cast("long").alias("lag"), rounded(G.pearson_p("r", "pairs")).alias("p"))


view("scan_sig_rolling", rolling_sql("select symbol, lag from scan_p where p<0.05"))
view("scan_class", f"""
 select p.symbol, p.lag, windows, significant, case when significant/windows>=0.6e0 then 'shift_feature' else 'rolling_corr' end \"action\" from scan_p p
 join (select symbol, lag, count(*) windows, count(*) filter (where {p_sql('r', 'pairs')}<0.05) significant from scan_sig_rolling group by 1,2) w using (symbol, lag) where p<0.05""")


def classified(spark, sf):
    w = stored_weeks(spark, sf)
    p = cut(with_p(spark, sf, w), "scan_p")
    rolling = G.rolling_scan(w, KEYS, "d", "x", "y", p.filter(F.col("p") < G.ALPHA))
    return G.classify(p, rolling, KEYS), p


@query("ccf_classify", "select symbol, lag, windows, significant, \"action\" from scan_class")
def ccf_classify(spark, sf):
    out, _ = classified(spark, sf)
    return out.select("symbol", F.col("lag").cast("long").alias("lag"), "windows", "significant", "action")


@query("lag_config", f"""
 with b as (select symbol, string_agg(lag::varchar, ',' order by lag) significant_lags, max(abs(r)) best from scan_p where p<0.05 group by 1),
 k as (select symbol, coalesce(string_agg(lag::varchar, ',' order by lag) filter (where \"action\"='shift_feature'),'') stable_lags,
  coalesce(string_agg(lag::varchar, ',' order by lag) filter (where \"action\"='rolling_corr'),'') unstable_lags from scan_class group by 1)
 select symbol, significant_lags, {sround('best', 4)} best_abs_r, stable_lags, unstable_lags from b join k using (symbol)""")
def lag_config(spark, sf):
    out, p = classified(spark, sf)
    cfg = G.lag_config(out, p, KEYS)
    text = lambda c: F.concat_ws(",", F.transform(c, lambda v: v.cast("string")))
    return cfg.select("symbol", text("significant_lags_weeks").alias("significant_lags"), rounded("best_abs_r", 4).alias("best_abs_r"),
                      text("stable_lags").alias("stable_lags"), text("unstable_lags").alias("unstable_lags"))
