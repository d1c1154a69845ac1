"""Section 2.6: window functions. Tick queries use series that hold a fifth of all rows each."""

from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.nullsafe import flag, ratio, rounded
from ..operators import clean
from ..operators.ordered import Run, ewm_layers, ewm_reach, hold, over_rows, positions, running, side_by_side
from ..sources import tables as t
from . import query, view
from .views import full, sround

KEY = ["sensor"]
W = "partition by sensor order by seq"
B = "partition by symbol order by d"
view("tick_rows", f"select *, row_number() over ({W}) rn from ticks")
view("bar_rows", f"select *, row_number() over ({B}) rn, lag(close) over ({B}) pc from bars")


def _ticks(spark, sf, layers, before, after=0):
    return over_rows(t.ticks(spark, sf), KEY, "seq", layers, before, after)


def _bars(spark, sf, layers, before, after=0):
    return over_rows(t.bars(spark, sf), ["symbol"], "d", layers, before, after)


def _out(df, keys, cols, digits=6):
    return df.select(*keys, *[rounded(c, digits).alias(c) for c in cols])


@query("lag_lead", f"""
 select sensor, seq, lag(v,1) over ({W}) lag_1, lag(v,2) over ({W}) lag_2, lag(v,21) over ({W}) lag_21,
  lag(v,170) over ({W}) lag_170, lead(v,7) over ({W}) lead_7 from ticks""")
def lag_lead(spark, sf):
    layer = lambda c: {
        **{f"lag_{n}": R.shift(c, "v", n) for n in (1, 2, 21, 170)}, "lead_7": R.shift(c, "v", -7)
    }
    return _ticks(spark, sf, [layer], 170, 7).select("sensor", "seq", "lag_1", "lag_2", "lag_21", "lag_170", "lead_7")


@query("configured_lags", f"""
 select symbol, d, {sround(f'lag(volume,15) over ({B})')} volume_lag_3w, {sround(f'lag(close,45) over ({B})')} close_lag_9w from bars""")
def configured_lags(spark, sf):
    from ..operators.lagscan import shift_layer

    actions = {"volume": {3: "shift_feature", 5: "rolling_corr"}, "close": {9: "shift_feature"}}
    out = _bars(spark, sf, [shift_layer(actions, rows_per_week=5)], 45)
    return _out(out, ["symbol", "d"], ["volume_lag_3w", "close_lag_9w"])


@query("diff_pct_change", f"""
 with f as (select *, last_value(x ignore nulls) over ({W} rows between unbounded preceding and current row) fx from ticks)
 select sensor, seq, {sround(f'x-lag(x) over ({W})')} diff_1, {sround(f'fx/nullif(lag(fx,1) over ({W}),0)-1')} change_1,
  {sround(f'fx/nullif(lag(fx,12) over ({W}),0)-1')} change_12 from f""")
def diff_pct_change(spark, sf):
    raw = t.ticks(spark, sf).withColumn("fx", F.col("x"))
    carried = clean.forward_fill(raw, KEY, "seq", ["fx"])
    out = over_rows(carried, KEY, "seq", [lambda c: {
        "diff_1": R.diff(c, "x"), "change_1": R.change(c, "fx"), "change_12": R.change(c, "fx", 12)}], 12)
    return _out(out, ["sensor", "seq"], ["diff_1", "change_1", "change_12"])


@query("log_return", f"select symbol, d, {sround('ln(close/pc)')} log_return from bar_rows")
def log_return(spark, sf):
    out = _bars(spark, sf, [lambda c: {"log_return": R.log_return(c, "close")}], 1)
    return _out(out, ["symbol", "d"], ["log_return"])


@query("rolling_mean_sum_std", f"""
 select sensor, seq, {sround(full('avg', 'x', 7, 'sensor', 'seq'))} mean_7, {sround(full('sum', 'x', 30, 'sensor', 'seq'))} sum_30,
  {sround(full('stddev_samp', 'v', 50, 'sensor', 'seq'))} std_50, {sround(full('avg', 'v', 14, 'sensor', 'seq'))} mean_14 from ticks""")
def rolling_mean_sum_std(spark, sf):
    out = _ticks(spark, sf, [lambda c: {
        "mean_7": R.mean(c, "x", 7), "sum_30": R.total(c, "x", 30),
        "std_50": R.std(c, "v", 50), "mean_14": R.mean(c, "v", 14)}], 50)
    return _out(out, ["sensor", "seq"], ["mean_7", "sum_30", "std_50", "mean_14"])


@query("rolling_mean_min1", f"""
 select sensor, seq, {sround(f'avg(x) over ({W} rows between 6 preceding and current row)')} smooth from ticks""")
def rolling_mean_min1(spark, sf):
    return _out(_ticks(spark, sf, [lambda c: {"smooth": R.mean_partial(c, "x", 7)}], 7), ["sensor", "seq"], ["smooth"])


@query("rolling_corr", f"""
 with r as (select symbol, d, ln(close/pc) lr, volume/nullif(lag(volume) over ({B}),0)-1 dv from bar_rows),
 p as (select symbol, d, case when dv is not null then lr end a, case when lr is not null then dv end b from r)
 select symbol, d, {sround('''case when count(a) over w>=10 then covar_samp(a,b) over w/nullif(stddev_samp(a) over w*stddev_samp(b) over w,0) end''')} price_vol_corr
 from p window w as ({B} rows between 9 preceding and current row)""")
def rolling_corr(spark, sf):
    out = _bars(spark, sf, [
        lambda c: {"lr": R.log_return(c, "close"), "dv": R.change(c, "volume")},
        lambda c: {"price_vol_corr": R.corr(c, "lr", "dv", 10)}], 11)
    return _out(out, ["symbol", "d"], ["price_vol_corr"])


def _ewm_sql(src: str, key: str, order: str, c: str, spans: list[int], names: list[str]) -> str:
    parts = [
        f"sum(b.{c}*pow({1 - 2 / (s + 1)!r}::double,a.rn-b.rn))/sum(case when b.{c} is not null then pow({1 - 2 / (s + 1)!r}::double,a.rn-b.rn) end) {n}"
        for s, n in zip(spans, names)
    ]
    return f"select a.{key}, a.{order}, {', '.join(parts)} from {src} a join {src} b on a.{key}=b.{key} and b.rn<=a.rn group by 1,2"


view("tick_ewm", _ewm_sql("tick_rows", "sensor", "seq", "x", [9, 26], ["ewm_9", "ewm_26"]))


@query("ewm_adjusted", f"select sensor, seq, {sround('ewm_9')} ewm_9, {sround('ewm_26')} ewm_26 from tick_ewm")
def ewm_adjusted(spark, sf):
    layers = side_by_side(ewm_layers("ewm_9", "x", 9), ewm_layers("ewm_26", "x", 26))
    names = ["ewm_9", "ewm_26"]
    return _out(hold(_ticks(spark, sf, layers, ewm_reach(26)), KEY, "seq", names), ["sensor", "seq"], names)


Q30 = repr(1 - 2 / 31)


@query("ewm_recursive", f"""
 select a.sensor, a.seq, {sround(f'sum(b.v*pow({Q30}::double,a.rn-b.rn)*case when b.rn=1 then 1e0 else 2e0/31 end)')} trend
 from tick_rows a join tick_rows b on a.sensor=b.sensor and b.rn<=a.rn group by 1,2""")
def ewm_recursive(spark, sf):
    layers = ewm_layers("trend", "v", 30, adjust=False)
    return _out(hold(_ticks(spark, sf, layers, ewm_reach(30)), KEY, "seq", ["trend"]), ["sensor", "seq"], ["trend"])


@query("run_length", f"""
 with f as (select *, coalesce(v<20,false)::int dry from ticks),
 g as (select *, sum(1-dry) over ({W}) isl from f)
 select sensor, seq, dry, cast(sum(dry) over (partition by sensor, isl order by seq) as bigint) dry_run from g""")
def run_length(spark, sf):
    f = t.ticks(spark, sf).withColumn("dry", flag(F.col("v") < 20))
    return clean.run_length(f, KEY, "seq", ["dry"]).select("sensor", "seq", "dry", "dry_run")


@query("dry_window_flag", """
 select region, d, coalesce(s=0,false)::int dry_days_7d from (select region, d, case when count(*) over w>=7 then sum(precip) over w end s
 from weather window w as (partition by region order by d rows between 6 preceding and current row))""")
def dry_window_flag(spark, sf):
    out = over_rows(t.weather(spark, sf), ["region"], "d", [lambda c: {"dry_days_7d": flag(R.total(c, "precip", 7) == 0)}], 7)
    return out.select("region", "d", "dry_days_7d")


def _rsi_sql(value: str) -> str:
    gain, loss = full("avg", "up", 14, "symbol"), full("avg", "dn", 14, "symbol")
    return f"""with m as (select symbol, d, case when close-pc>0 then close-pc else 0 end up, case when close-pc<0 then pc-close else 0 end dn from bar_rows),
 g as (select symbol, d, {gain} gain, {loss} loss from m) select symbol, d, {value} from g"""


@query("rsi", _rsi_sql(
    sround("100-100/(1+gain/nullif(loss,0))") + " rsi_null, "
    + sround("case when loss=0 and gain>0 then 100 else 100-100/(1+gain/nullif(loss,0)) end") + " rsi_limit"))
def rsi(spark, sf):
    layers = side_by_side(R.rsi_layers("rsi_null", "close"), R.rsi_layers("rsi_limit", "close", zero_loss="limit"))
    return _out(_bars(spark, sf, layers, 15), ["symbol", "d"], ["rsi_null", "rsi_limit"])


@query("bollinger", f"""
 select symbol, d, {sround('m', 8)} middle, {sround('m+2*s', 8)} upper, {sround('m-2*s', 8)} lower from
 (select symbol, d, {full('avg', 'close', 20, 'symbol')} m, {full('stddev_samp', 'close', 20, 'symbol')} s from bars)""")
def bollinger(spark, sf):
    def layer(c):
        mid, up, low = R.bollinger(c, "close")
        return {"middle": mid, "upper": up, "lower": low}

    return _out(_bars(spark, sf, [layer], 20), ["symbol", "d"], ["middle", "upper", "lower"], 8)


view("bar_ewm", _ewm_sql("bar_rows", "symbol", "d", "close", [12, 26, 20], ["e12", "e26", "e20"]))
view("bar_macd", "select symbol, d, e12-e26 macd, row_number() over (partition by symbol order by d) rn from bar_ewm")
view("bar_signal", _ewm_sql("bar_macd", "symbol", "d", "macd", [9], ["sig"]))


@query("macd", f"""
 select symbol, d, {sround('macd')} macd, {sround('sig')} macd_signal, {sround('macd-sig')} macd_hist
 from bar_macd join bar_signal using (symbol, d)""")
def macd(spark, sf):
    layers = R.macd_layers("close")
    out = _bars(spark, sf, layers, ewm_reach(26) + ewm_reach(9))
    return _out(out, ["symbol", "d"], ["macd", "macd_signal", "macd_hist"])


@query("momentum", f"""
 select symbol, d, {sround(f'close/lag(close,5) over ({B})-1')} momentum_1w, {sround(f'close/lag(close,21) over ({B})-1')} momentum_1m from bars""")
def momentum(spark, sf):
    out = _bars(spark, sf, [lambda c: {"momentum_1w": R.change(c, "close", 5), "momentum_1m": R.change(c, "close", 21)}], 21)
    return _out(out, ["symbol", "d"], ["momentum_1w", "momentum_1m"])


@query("realized_vol", f"""
 with r as (select symbol, d, ln(close/pc) lr from bar_rows),
 v as (select symbol, d, {full('stddev_samp', 'lr', 5, 'symbol')}*sqrt(252e0) rv_5d, {full('stddev_samp', 'lr', 10, 'symbol')}*sqrt(252e0) rv_10d,
  {full('stddev_samp', 'lr', 20, 'symbol')}*sqrt(252e0) rv_20d from r)
 select symbol, d, {sround('rv_5d')} rv_5d, {sround('rv_10d')} rv_10d, {sround('rv_20d')} rv_20d, {sround('rv_5d/(rv_20d+1e-8)')} rv_ratio from v""")
def realized_vol(spark, sf):
    out = _bars(spark, sf, [
        lambda c: {"__lr": R.log_return(c, "close")},
        lambda c: {f"rv_{n}d": R.annualised(c, "__lr", n, 252) for n in (5, 10, 20)},
        lambda c: {"rv_ratio": ratio("rv_5d", F.col("rv_20d") + 1e-8)}], 21)
    return _out(out, ["symbol", "d"], ["rv_5d", "rv_10d", "rv_20d", "rv_ratio"])


@query("range_features", f"""
 with r as (select symbol, d, (high-low)/nullif(close,0) hl from bars),
 v as (select symbol, d, hl, {full('avg', 'hl', 5, 'symbol')} m5, {full('avg', 'hl', 20, 'symbol')} m20 from r)
 select symbol, d, {sround('hl')} hl_range_pct, {sround('m5')} hl_range_ma5, {sround('m20')} hl_range_ma20, {sround('hl/(m20+1e-8)')} hl_expansion from v""")
def range_features(spark, sf):
    out = _bars(spark, sf, [
        lambda c: {"hl_range_pct": ratio(F.col("high") - F.col("low"), "close")},
        lambda c: {"hl_range_ma5": R.mean(c, "hl_range_pct", 5), "hl_range_ma20": R.mean(c, "hl_range_pct", 20)},
        lambda c: {"hl_expansion": ratio("hl_range_pct", F.col("hl_range_ma20") + 1e-8)}], 20)
    return _out(out, ["symbol", "d"], ["hl_range_pct", "hl_range_ma5", "hl_range_ma20", "hl_expansion"])


@query("volume_ratio", f"select symbol, d, {sround('volume/('+full('avg','volume',20,'symbol')+'+1e-8)')} volume_ratio from bars")
def volume_ratio(spark, sf):
    out = _bars(spark, sf, [lambda c: {"volume_ratio": ratio("volume", R.mean(c, "volume", 20) + 1e-8)}], 20)
    return _out(out, ["symbol", "d"], ["volume_ratio"])


@query("cumulative_equity", f"""
 select sensor, seq, {sround(f'exp(sum(ln(1+(k-50)/1e5)) over ({W} rows between unbounded preceding and current row))')} equity from ticks""")
def cumulative_equity(spark, sf):
    step = 1 + (F.col("k") - 50) / 1e5
    out = running(t.ticks(spark, sf), KEY, "seq", {"equity": Run("product", step)})
    return _out(out, ["sensor", "seq"], ["equity"])


@query("running_peak", f"select sensor, seq, max(x) over ({W} rows between unbounded preceding and current row) peak from ticks")
def running_peak(spark, sf):
    out = running(t.ticks(spark, sf), KEY, "seq", {"peak": Run("max", F.col("x"))})
    return out.select("sensor", "seq", "peak")


@query("rank_fraction", f"""
 select sensor, seq, {sround('(rank() over (partition by sensor order by v)+(count(*) over (partition by sensor, v)-1)/2e0)/count(*) over (partition by sensor)')} rank_fraction from ticks""")
def rank_fraction(spark, sf):
    from ..operators.metrics import rank_fraction as ranked

    out = ranked(t.ticks(spark, sf), KEY, "v", "rank_fraction")
    return _out(out, ["sensor", "seq"], ["rank_fraction"])


@query("position_index", f"select sensor, seq, row_number() over ({W}) rn, count(*) over (partition by sensor) n from ticks")
def position_index(spark, sf):
    return positions(t.ticks(spark, sf), KEY, "seq", "rn", "n").select("sensor", "seq", "rn", "n")
