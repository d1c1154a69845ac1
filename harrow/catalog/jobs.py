"""Section 2.15: feature assemblies. Odd symbols are corn, even ones coffee."""

from pyspark.sql import functions as F

from ..functions.nullsafe import rounded
from ..operators import labels
from ..operators import lagscan as G
from ..operators.ordered import over_rows
from ..plans import calendars, integrate, macro, market, reports, weather
from ..sources import tables as t
from ..sources.sinks import cut
from . import query, view
from .lags import DRAWS, p_sql
from .resampling import report_wide
from .scalars import label_of
from .views import full, sround
from .windows import _ewm_sql


def _r(df, keys, cols, digits=6):
    return df.select(*keys, *[rounded(c, digits).alias(c) for c in cols])


def spike_limit():
    return F.when(F.col("symbol") % 2 == 0, market.SPIKE_LIMIT["coffee"]).otherwise(market.SPIKE_LIMIT["corn"])


def market_daily(spark, sf):
    return market.daily_features(t.bars(spark, sf), ["symbol"], spike_limit())


def despike_sql(src: str, part: str, lim: str, cols=("close", "high", "low"), keep: str = "") -> str:
    """Spikes of several columns cut and interpolated by row position."""
    o = f"(partition by {part} order by d)" if part else "(order by d)"
    inner, fill = [], []
    for c in cols:
        p, n = f"lag({c}) over {o}", f"lead({c}) over {o}"
        inner.append(f"case when coalesce(abs(({c}-{p})/{p})>{lim} and abs(({n}-{c})/{c})>{lim} and ({c}-{p})*({n}-{c})<0,false) then null else {c} end {c}_0")
        back = o[:-1] + " rows between unbounded preceding and current row)"
        ahead = o[:-1] + " rows between current row and unbounded following)"
        at = f"case when {c}_0 is not null then pos end"
        bv, bp = f"last_value({c}_0 ignore nulls) over {back}", f"last_value({at} ignore nulls) over {back}"
        av, ap = f"first_value({c}_0 ignore nulls) over {ahead}", f"first_value({at} ignore nulls) over {ahead}"
        fill.append(f"coalesce({c}_0, {bv}+({av}-{bv})/({ap}-{bp})*(pos-{bp}), {bv}) as {c}")
    key = f"{part}," if part else ""
    return f"""select {key} d, pos {keep}, close, case when high is not null and close is not null then greatest(high,close) end high, case when low is not null and close is not null then least(low,close) end low
 from (select {key} d, pos {keep}, {', '.join(fill)} from (select *, {', '.join(inner)} from (select *, row_number() over {o} pos from {src})))"""


view("m_clean", despike_sql("(select * from bars)", "symbol", "(case when symbol%2=0 then 0.06e0 else 0.05e0 end)", keep=", open, volume"))
view("m_rows", "select *, pos rn, lag(close) over (partition by symbol order by d) pc from m_clean")
view("m_ewm", _ewm_sql("m_rows", "symbol", "d", "close", [12, 26, 20], ["e12", "e26", "e20"]))
view("m_macd", "select symbol, d, e12-e26 macd, row_number() over (partition by symbol order by d) rn from m_ewm")
view("m_sig", _ewm_sql("m_macd", "symbol", "d", "macd", [9], ["sig"]))
P = "symbol"
view("m_feat", f"""
 select symbol, d, open, high, low, close, volume, lr log_return,
  case when loss=0 and gain>0 then 100 else 100-100/(1+gain/nullif(loss,0)) end rsi_14, {full('stddev_samp', 'lr', 20, P)}*sqrt(252e0) volatility_20d,
  {full('avg', 'close', 20, P)} sma_20, {full('avg', 'close', 50, P)} sma_50, e20 ema_20,
  {full('avg', 'close', 20, P)}+2*{full('stddev_samp', 'close', 20, P)} bb_upper, {full('avg', 'close', 20, P)}-2*{full('stddev_samp', 'close', 20, P)} bb_lower,
  e12-e26 macd, sig macd_signal, close/lag(close,5) over (partition by symbol order by d)-1 momentum_1w, close/lag(close,21) over (partition by symbol order by d)-1 momentum_1m
 from (select *, ln(close/pc) lr, {full('avg', 'up', 14, P)} gain, {full('avg', 'dn', 14, P)} loss from
  (select *, case when close-pc>0 then close-pc else 0 end up, case when close-pc<0 then pc-close else 0 end dn from m_rows))
 join m_ewm using (symbol, d) join (select symbol, d, sig from m_sig) using (symbol, d)""")
LAST = ["close", "rsi_14", "sma_20", "sma_50", "ema_20", "bb_upper", "bb_lower", "macd", "macd_signal", "momentum_1w", "momentum_1m"]
WEEK = "cast(date_trunc('week', d + 6) as date)"
view("m_complete", "select * from m_feat where sma_50 is not null and rsi_14 is not null and volatility_20d is not null and momentum_1m is not null")
view("m_week", f"""
 select symbol, {WEEK} d, arg_min(open,d) open, max(high) high, min(low) low, sum(volume) volume, avg(volatility_20d) volatility_20d,
  {', '.join(f'arg_max({c},d) as {c}' for c in LAST)} from m_complete group by 1,2""")
M_OUT = ["open", "high", "low", "volatility_20d", *LAST]


# price levels sit on a decimal grid, where engines round halves differently; logs do not
LEVELS = ["open", "high", "low", "close", "sma_20", "sma_50"]
OTHER = [c for c in M_OUT if c not in LEVELS]


@query("job_market_features", f"select symbol, d, volume, {', '.join(f'{sround(f"ln({c})")} log_{c}' for c in LEVELS)}, {', '.join(f'{sround(c, 5)} {c}' for c in OTHER)} from m_week")
def job_market_features(spark, sf):
    out = market.weekly_features(market_daily(spark, sf), ["symbol"])
    logs = [rounded(F.ln(c)).alias(f"log_{c}") for c in LEVELS]
    return out.select("symbol", "d", "volume", *logs, *[rounded(c, 5).alias(c) for c in OTHER])


view("fx_bars", "select d, close, high, low, close as open, 1e0 volume from fx")


def fx_bars(spark, sf):
    return t.fx(spark, sf).withColumns({"open": F.col("close"), "volume": F.lit(1.0)})


view("f_clean", despike_sql("(select * from fx_bars)", "", "0.03e0", keep=", open, volume"))
view("f_feat", f"""
 select *, coalesce(100-100/(1+gain/nullif(loss,0)),50) rsi_14, case when count(lr) over w>=20 then stddev_samp(lr) over w end*sqrt(252e0) volatility_20d
 from (select *, ln(close/pc) lr, case when count(up) over g>=14 then avg(up) over g end gain, case when count(dn) over g>=14 then avg(dn) over g end loss
  from (select *, case when close-pc>0 then close-pc else 0 end up, case when close-pc<0 then pc-close else 0 end dn from (select *, lag(close) over (order by d) pc from f_clean))
  window g as (order by d rows between 13 preceding and current row)) window w as (order by d rows between 19 preceding and current row)""")
view("f_lags", """
 select *, lag(close,5) over o close_lag_1w, lag(close,21) over o close_lag_1m, lag(lr,5) over o log_return_lag_1w, lag(volatility_20d,5) over o volatility_lag_1w
 from (select * from f_feat where volatility_20d is not null) window o as (order by d)""")
F_LAST = ["close", "rsi_14", "close_lag_1w", "close_lag_1m", "log_return_lag_1w", "volatility_lag_1w"]
view("usd_week", f"""
 select * from (select {WEEK} d, arg_min(open,d) open, max(high) high, min(low) low, sum(volume) volume, avg(volatility_20d) volatility_20d, {', '.join(f'arg_max({c},d) as {c}' for c in F_LAST)} from f_lags group by 1)
 where close_lag_1m is not null and volatility_lag_1w is not null""")
F_OUT = ["high", "low", "volume", "volatility_20d", *F_LAST]


def usd_week(spark, sf):
    return macro.fx_weekly(fx_bars(spark, sf), [])


F_LEVELS = ["high", "low", "close", "close_lag_1w", "close_lag_1m"]
F_OTHER = [c for c in F_OUT if c not in F_LEVELS]


@query("job_fx_features", f"select d, {', '.join(f'{sround(f"ln({c})")} log_{c}' for c in F_LEVELS)}, {', '.join(f'{sround(c)} {c}' for c in F_OTHER)} from usd_week")
def job_fx_features(spark, sf):
    logs = [rounded(F.ln(c)).alias(f"log_{c}") for c in F_LEVELS]
    return usd_week(spark, sf).select("d", *logs, *[rounded(c).alias(c) for c in F_OTHER])


view("cpi_month", """
 select cast(d + interval 1 month as date)+12 d, v, (v/lag(v,1) over (order by d)-1)*100 mom_pct, (v/lag(v,12) over (order by d)-1)*100 yoy_pct from macro_monthly""")
view("cpi_daily", """
 select s.d, c.v, c.mom_pct, c.yoy_pct from (select cast(unnest(generate_series(lo,hi,interval 1 day)) as date) d from (select min(d) lo, max(d) hi from cpi_month)) s asof join cpi_month c on s.d>=c.d""")
view("inf_week", f"select * from (select {WEEK} d, arg_max(v,d) v, arg_max(mom_pct,d) mom_pct, arg_max(yoy_pct,d) yoy_pct from cpi_daily group by 1) where yoy_pct is not null")


def inf_week(spark, sf):
    return macro.inflation_weekly(t.macro_monthly(spark, sf), [])


@query("job_cpi_features", f"select d, {', '.join(f'{sround(c)} {c}' for c in macro.INDEX)} from inf_week")
def job_cpi_features(spark, sf):
    return _r(inf_week(spark, sf), ["d"], macro.INDEX)


view("vix_week", f"""
 select *, case when close>0 and close<=15 then 0e0 when close>15 and close<=25 then 1e0 when close>25 and close<=999 then 2e0 end regime from
 (select d, close, ln(close/lag(close) over (order by d)) log_return, case when count(close) over w>=4 then avg(close) over w end ma4 from
  (select {WEEK} d, arg_max(close*4,d) as close from fx group by 1) window w as (order by d rows between 3 preceding and current row)) where ma4 is not null and log_return is not null""")


def vix_week(spark, sf):
    index = t.fx(spark, sf).select("d", (F.col("close") * 4).alias("close"))
    return macro.volatility_weekly(index, [])


@query("job_vix_features", f"select d, {', '.join(f'{sround(c)} as {c}' for c in ('close', 'log_return', 'ma4'))}, regime from vix_week")
def job_vix_features(spark, sf):
    return vix_week(spark, sf).select("d", *[rounded(c).alias(c) for c in ("close", "log_return", "ma4")], "regime")


def w_clean_sql(c: str, src: str) -> str:
    """Isolated outliers and stuck readings of one column removed."""
    o = "partition by region order by d"
    q = f"over ({o} rows between 14 preceding and current row)"
    return f"""select region, d, case when sum(flat) over ({o} rows between 3 preceding and current row)>=4 then null else {c} end {c}
 from (select *, (coalesce(stddev_samp({c}) over ({o} rows between 4 preceding and current row),0)<1e-4)::int flat
 from (select region, d, case when s=1 and sum(s) over (partition by region, blk)<7 then null else {c} end {c}
 from (select *, sum(1-s) over ({o}) blk from (select *, coalesce({c}<q1-3*(q3-q1) or {c}>q3+3*(q3-q1),false)::int s
 from (select region, d, {c}, quantile_cont({c},0.25) {q} q1, quantile_cont({c},0.75) {q} q3 from {src})))))"""


for _c in ("temp_max", "temp_min", "et0", "vpd_max"):
    view(f"wc_{_c}", w_clean_sql(_c, "weather"))
view("w_clean", "select w.region, w.d, a.temp_max, b.temp_min, w.precip, c.et0, e.vpd_max from weather w join wc_temp_max a using (region,d) join wc_temp_min b using (region,d) join wc_et0 c using (region,d) join wc_vpd_max e using (region,d)")
W_COLS = ["temp_max", "temp_min", "precip", "et0", "vpd_max"]


@query("job_weather_clean", f"select region, d, {', '.join(f'{sround(c)} {c}' for c in W_COLS)} from w_clean")
def job_weather_clean(spark, sf):
    return _r(weather.cleaned(t.weather(spark, sf), ["region"]), ["region", "d"], W_COLS)


FILL = "last_value({c} ignore nulls) over (partition by region order by d rows between unbounded preceding and current row) {c}"
view("w_filled", f"select region, d, {', '.join(FILL.format(c=c) for c in W_COLS if c != 'precip')}, coalesce(precip,0) precip from w_clean")
R7, R14, R30 = (f"over (partition by region order by d rows between {n - 1} preceding and current row)" for n in (7, 14, 30))
view("w_feat", f"""
 select *, row_number() over (partition by region order by d) q, avg(temp_max) {R7} temp_max_rolling_7d, avg(temp_max) {R14} temp_max_rolling_14d, sum(temp_max) {R30} temp_max_cumsum_30d,
  temp_max-lag(temp_max) over (partition by region order by d) temp_max_diff_1d, stddev_samp(temp_max) {R7} temp_max_std_7d, sum(precip) {R7} precip_sum_rolling_7d,
  sum(precip) {R30} precip_cumsum_30d, (sum(precip) {R7}=0)::int dry_days_7d, avg(et0) {R7} et0_rolling_7d, sum(et0) {R30} et0_cumsum_30d, count(temp_max) {R30} ct, count(et0) {R30} ce, count(vpd_max) {R30} cv, count(temp_min) {R30} cm from w_filled""")
W_OUT = ["temp_max_rolling_7d", "temp_max_rolling_14d", "temp_max_cumsum_30d", "temp_max_diff_1d", "temp_max_std_7d", "precip_sum_rolling_7d", "precip_cumsum_30d", "et0_rolling_7d", "et0_cumsum_30d"]


@query("job_weather_features", f"select region, d, dry_days_7d, {', '.join(f'{sround(c)} {c}' for c in W_OUT)} from w_feat where q>=30 and ct=30 and ce=30 and vpd_max is not null and temp_min is not null")
def job_weather_features(spark, sf):
    clean = weather.cleaned(t.weather(spark, sf), ["region"])
    return _r(weather.station_features(clean, ["region"]), ["region", "d", "dry_days_7d"], W_OUT)


C_FLAGS = ["is_planting", "is_pollination", "is_harvest"]


def run_sql(f: str) -> str:
    return f"case when {f}=1 then row_number() over (partition by {f}, pos-r_{f} order by d) else 0 end {f}_duration"


view("cal_week", f"""
 select *, {', '.join(run_sql(f) for f in C_FLAGS)} from (select *, {', '.join(f'row_number() over (partition by {f} order by d) r_{f}' for f in C_FLAGS)} from
 (select *, row_number() over (order by d) pos from (select {WEEK} d, {', '.join(f'max({f}) {f}' for f in C_FLAGS)} from cal_corn group by 1)))""")
view("cal_week_full", f"""
 select d, {', '.join(C_FLAGS)}, {', '.join(f + '_duration' for f in C_FLAGS)}, sin(2*pi()*month(d)/12e0) sin_month, cos(2*pi()*month(d)/12e0) cos_month,
  sin(2*pi()*week(d)/52e0) sin_week, cos(2*pi()*week(d)/52e0) cos_week from cal_week""")
CYC = ["sin_month", "cos_month", "sin_week", "cos_week"]


def cal_week(spark, sf, crop="corn"):
    return calendars.calendar_features(t.calendar(spark, sf, crop), [])


@query("job_calendar_features", f"select d, {', '.join(C_FLAGS)}, {', '.join(f + '_duration' for f in C_FLAGS)}, {', '.join(f'{sround(c)} {c}' for c in CYC)} from cal_week_full")
def job_calendar_features(spark, sf):
    return _r(cal_week(spark, sf), ["d", *C_FLAGS, *[f + "_duration" for f in C_FLAGS]], CYC)


CORN = ["corn_planting_pct", "corn_emerged_pct", "corn_silking_pct", "corn_harvest_pct", "corn_condition_ge_pct", "corn_condition_pvp_pct", "corn_stress_index", "corn_signal_encoded", "corn_iowa_planting_pct"]
view("corn_week", """
 select u.week_ending d, u.planting_pct corn_planting_pct, null::double corn_emerged_pct, null::double corn_silking_pct, u.harvested_pct corn_harvest_pct,
  coalesce(u.condition_good_pct,0)+coalesce(u.condition_excellent_pct,0) corn_condition_ge_pct, coalesce(u.condition_poor_pct,0)+coalesce(u.condition_very_poor_pct,0) corn_condition_pvp_pct,
  (coalesce(u.condition_poor_pct,0)+coalesce(u.condition_very_poor_pct,0))/100 corn_stress_index,
  case when coalesce(u.condition_poor_pct,0)+coalesce(u.condition_very_poor_pct,0)>=30 then -1 when coalesce(u.condition_poor_pct,0)+coalesce(u.condition_very_poor_pct,0)<=10 then 1 else 0 end corn_signal_encoded,
  i.planting_pct corn_iowa_planting_pct from report_wide u left join report_wide i on i.week_ending=u.week_ending and i.state='IOWA' where u.state='US TOTAL'""")


def both_fill(c: str) -> str:
    back, ahead = "rows between unbounded preceding and current row", "rows between current row and unbounded following"
    return f"coalesce(last_value({c} ignore nulls) over (order by d {back}), first_value({c} ignore nulls) over (order by d {ahead})) {c}"


view("corn_daily", f"""
 select d, {', '.join(both_fill(c) for c in CORN)} from (select cast(unnest(generate_series(lo,hi,interval 1 day)) as date) d from (select min(d) lo, max(d) hi from corn_week)) left join corn_week using (d)""")


@query("job_corn_report_features", f"select d, {', '.join(f'{sround(c)} {c}' if c != 'corn_signal_encoded' else c for c in CORN)} from corn_daily")
def job_corn_report_features(spark, sf):
    out = reports.corn_features(report_wide(spark, sf))
    return out.select("d", *[F.col(c) if c == "corn_signal_encoded" else rounded(c).alias(c) for c in CORN])


def coffee_reports(spark, sf):
    """One extracted report per station day, written from the readings of that day."""
    w = t.weather(spark, sf).groupBy("d").agg(
        F.max("temp_max").alias("hi"), F.min("temp_min").alias("lo"), F.max_by("region", F.struct("temp_max", "region")).alias("sensor"))
    stage = F.when(F.col("hi") < 60, "flowering").when(F.col("hi") < 90, "harvest").when(F.col("hi") < 120, "hibernation")
    doc = F.struct(
        F.col("d").cast("string").alias("report_date"),
        F.struct(stage.alias("stage"), F.least(F.floor("lo"), F.lit(100)).cast("int").alias("harvest_completion_pct"),
                 F.round("lo", 2).alias("production_change_vs_last_year_pct")).alias("national"),
        F.create_map(F.lit("sul_de_minas"), F.struct(F.when(F.col("lo") < 1, "good").when(F.col("lo") < 3, "odd").alias("condition"))).alias("regions"),
        F.array(F.when(F.col("hi") >= 90, "long drought").otherwise("frost")).alias("weather_events"), label_of().alias("signal"))
    text = w.select("d", F.to_json(doc).alias("text"))
    return reports.parse_coffee(text, "text", ["d"]).filter("accepted")


COFFEE = ["coffee_stage_encoded", "coffee_harvest_completion", "coffee_production_change_pct", "coffee_sul_minas_condition", "coffee_signal_encoded", "coffee_flowering_flag", "coffee_drought_flag"]
view("coffee_docs", """
 select d, case when hi<60 then 1 when hi<90 then 4 else 0 end coffee_stage_encoded, least(floor(lo),100)::int coffee_harvest_completion, round(lo,2) coffee_production_change_pct,
  case when lo<1 then 3 else 2 end coffee_sul_minas_condition, 0 coffee_signal_encoded, (hi<60)::int coffee_flowering_flag, (hi>=90)::int coffee_drought_flag
 from (select d, max(temp_max) hi, min(temp_min) lo from weather group by 1)""")
view("coffee_daily", f"""
 select d, {', '.join(both_fill(c) for c in COFFEE)} from (select cast(unnest(generate_series(lo,hi,interval 1 day)) as date) d from (select min(d) lo, max(d) hi from coffee_docs)) left join coffee_docs using (d)""")


@query("job_coffee_report_features", f"select d, {', '.join(COFFEE)} from coffee_daily")
def job_coffee_report_features(spark, sf):
    return reports.coffee_features(coffee_reports(spark, sf)).select("d", *COFFEE)


CORN_REGIONS = ["error", "purchase"]


def backbone(spark, sf, crop):
    w = t.weather(spark, sf)
    corn = F.col("region").isin(*CORN_REGIONS)
    return weather.backbone(w.filter(corn if crop == "corn" else ~corn), [])


def of_crop(crop):
    return F.col("symbol") % 2 == (1 if crop == "corn" else 0)


def crop_sources(spark, sf, crop, bars, shared):
    """Daily market features, dated sources and weather of a crop."""
    mine = bars.filter(of_crop(crop))
    # series keep this layout to the end, and rows widen after it, so the size of a task is set here, not by the bytes of the shuffle
    mine = mine.repartition(t.layout_parts(spark, mine.count()), "symbol")
    daily = market.daily_features(mine, ["symbol"], market.SPIKE_LIMIT[crop])
    sources = {"usd_": shared["usd_"], "inf_": shared["inf_"], "cal_": cal_week(spark, sf, crop), "vix_": shared["vix_"]}
    return daily, sources, backbone(spark, sf, crop)


def integrated(spark, sf, crop, weekly, bars, shared, lag_actions=None):
    """The table of one crop; only the weekly form reads the daily features twice."""
    daily, sources, weather_days = crop_sources(spark, sf, crop, bars, shared)
    daily = cut(daily, "market") if weekly else daily
    return integrate.integrate(daily, ["symbol"], sources, weather_days, crop, weekly, lag_actions=lag_actions, first=longest(bars, crop))


def longest(bars, crop):
    """The condition for the series of a crop that has the most bars, if there is one."""
    counts = bars.filter(of_crop(crop)).groupBy("symbol").count()
    top = counts.agg(F.max(F.struct("count", "symbol")).alias("top")).first()["top"]
    return F.col("symbol") == top["symbol"] if top else None


def shared_inputs(spark, sf):
    """What both crops use, bars and dated tables, made once."""
    bars = cut(t.bars(spark, sf), "bars")
    return bars, {"usd_": cut(usd_week(spark, sf), "usd"), "inf_": cut(inf_week(spark, sf), "inf"), "vix_": cut(vix_week(spark, sf), "vix")}


def both_crops(spark, sf, weekly):
    """The integrated tables of all symbols, each with the columns of its crop."""
    bars, shared = shared_inputs(spark, sf)
    parts = [integrated(spark, sf, crop, weekly, bars, shared).withColumn("crop", F.lit(crop)) for crop in ("corn", "coffee")]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


REG = "partition by region order by d"
view("bb_smooth", f"""
 select region, d, temp_max, temp_min, vpd_max, avg(precip) over ({REG} rows between 6 preceding and current row) precip, avg(et0) over ({REG} rows between 6 preceding and current row) et0
 from weather""")
view("bb_weekend", f"select region, {WEEK} d, avg(temp_max) weekend_temp_max, sum(precip) weekend_precip_sum, avg(et0) weekend_et0 from bb_smooth where isodow(d) in (6,7) group by 1,2")
view("bb_flags", f"""
 select region, d, temp_max, temp_min, vpd_max, precip, et0, {', '.join(f'last_value({c} ignore nulls) over ({REG} rows between unbounded preceding and current row) {c}' for c in weather.WEEKEND)},
  (temp_max>30)::int hot_day, (temp_max<10)::int cold_day, (precip=0)::int dry_day from bb_smooth left join bb_weekend using (region, d)""")
view("bb_spell", f"""
 select *, sum(dry_day) over (partition by region, blk order by d) dry_spell from (select *, sum(1-dry_day) over ({REG}) blk from bb_flags)""")
BB = ["temp_max", "temp_min", "vpd_max", "precip", "et0", *weather.WEEKEND, "hot_day", "cold_day", "dry_day", "dry_spell"]
view("bb_crop", f"select d, (region in ('error','purchase'))::int odd, {', '.join(f'avg({c}) {c}' for c in BB)} from bb_spell group by 1,2")
SYM = "partition by symbol order by d"
CARRIED = [*BB, "usd_close", "usd_lag_ret", "inf_mom_pct", "cal_sin_week", "vix_regime"]
view("i_joined", """
 select m.symbol, m.d, m.high, m.low, m.close, m.volume, b.* exclude (d, odd), u.close usd_close, u.log_return_lag_1w usd_lag_ret, i.mom_pct inf_mom_pct, c.sin_week cal_sin_week, v.regime vix_regime
 from m_complete m left join bb_crop b on b.d=m.d and b.odd=m.symbol%2 left join usd_week u on u.d=m.d left join inf_week i on i.d=m.d left join cal_week_full c on c.d=m.d left join vix_week v on v.d=m.d""")
view("i_carried", f"""
 select symbol, d, high, low, close, volume, row_number() over ({SYM}) rn, {', '.join(f'last_value({c} ignore nulls) over ({SYM} rows between unbounded preceding and current row) {c}' for c in CARRIED)} from i_joined""")
view("i_base", f"""
 select *, close*usd_close adj, usd_lag_ret*100-inf_mom_pct inflation_pressure, lag(close,2) over ({SYM}) close_lag_2, case when symbol%2=1 then lag(weekend_temp_max,45) over ({SYM}) else lag(weekend_temp_max,170) over ({SYM}) end temp_bio_lag,
  (high-low)/nullif(close,0) hl, volume/({full('avg', 'volume', 20, 'symbol')}+1e-8) volume_ratio, volume/nullif(lag(volume) over ({SYM}),0)-1 dv, ln(usd_close/lag(usd_close) over ({SYM})) ur,
  min(case when weekend_temp_max is not null then rn end) over (partition by symbol) rn0 from i_carried""")
view("i_ret", f"""
 select *, count(temp_bio_lag) over (partition by symbol%2) bio_rows, ln(adj/lag(adj) over ({SYM})) lr, adj-lag(adj) over ({SYM}) dl, lead(adj,7) over ({SYM})/adj-1 r,
  {full('avg', 'adj', 14, 'symbol')}+2*{full('stddev_samp', 'adj', 14, 'symbol')} bb_upper_adj, {full('avg', 'hl', 20, 'symbol')} hl20,
  {full('stddev_samp', 'ur', 5, 'symbol')}*sqrt(252e0) u5, {full('stddev_samp', 'ur', 20, 'symbol')}*sqrt(252e0) u20 from i_base""")
view("i_third", f"""
 select *, {full('stddev_samp', 'lr', 5, 'symbol')}*sqrt(252e0) rv_5d, {full('stddev_samp', 'lr', 20, 'symbol')}*sqrt(252e0) rv_20d, {full('avg', 'up', 14, 'symbol')} gain, {full('avg', 'dn', 14, 'symbol')} loss,
  case when count(pa) over p10>=10 then covar_samp(pa,pb) over p10/nullif(stddev_samp(pa) over p10*stddev_samp(pb) over p10,0) end price_vol_corr
 from (select *, case when dl>0 then dl else 0 end up, case when dl<0 then -dl else 0 end dn, case when dv is not null then lr end pa, case when lr is not null then dv end pb from i_ret)
 window p10 as ({SYM} rows between 9 preceding and current row)""")
Q14, Q30 = repr(1 - 2 / 15), repr(1 - 2 / 31)
view("i_ewm", f"""
 select a.symbol, a.d, sum(b.adj*pow({Q14}::double,a.rn-b.rn))/sum(case when b.adj is not null then pow({Q14}::double,a.rn-b.rn) end) ema_adj,
  sum(b.weekend_temp_max*pow({Q30}::double,a.rn-b.rn)*case when b.rn=b.rn0 then 1e0 else 2e0/31 end) temp_wavelet_trend
 from i_base a join i_base b on a.symbol=b.symbol and b.rn<=a.rn group by 1,2""")
view("i_final", """
 select *, 100-100/(1+gain/nullif(loss,0)) rsi_adj, rv_5d/(rv_20d+1e-8) rv_ratio, hl/(hl20+1e-8) hl_expansion, u5/(u20+1e-8) usd_rv_ratio,
  1/(1+exp((r+0.025e0)/0.02e0)) pd, 1/(1+exp(-(r-0.025e0)/0.02e0)) pu, greatest(0,1-1/(1+exp((r+0.025e0)/0.02e0))-1/(1+exp(-(r-0.025e0)/0.02e0))) pf
 from i_third join i_ewm using (symbol, d) where r is not null and (temp_bio_lag is not null or bio_rows=0) and rv_20d is not null and hl20 is not null and u20 is not null and price_vol_corr is not null and volume_ratio is not null
  and loss>0 and gain is not null and inflation_pressure is not null and vix_regime is not null and cal_sin_week is not null and close_lag_2 is not null and bb_upper_adj is not null and weekend_et0 is not null""")
I_OUT = ["temp_max", "dry_spell", "weekend_temp_max", "inf_mom_pct", "cal_sin_week", "vix_regime", "currency_adjusted_close", "inflation_pressure", "temp_bio_lag", "temp_wavelet_trend",
         "bb_upper_adj", "ema_adj", "rsi_adj", "rv_5d", "rv_ratio", "hl_expansion", "volume_ratio", "price_vol_corr", "usd_rv_ratio", "return_future", "target_mc_up",
         "volume", "temp_min", "vpd_max", "precip", "et0", "weekend_precip_sum", "weekend_et0", "hot_day", "cold_day", "dry_day", "usd_close",
         "usd_log_return_lag_1w", "hl_range_pct", "hl_range_ma20", "usd_rv_5d", "usd_rv_20d", "rv_20d", "target_mc_down", "target_mc_flat", "target_soft", "target_reg"]
I_SQL = {"currency_adjusted_close": "adj", "return_future": "r", "target_mc_up": "pu/(pd+pf+pu)", "target_mc_down": "pd/(pd+pf+pu)", "target_mc_flat": "pf/(pd+pf+pu)",
         "target_soft": "pu", "target_reg": "greatest(-0.3e0,least(0.3e0,r))", "usd_log_return_lag_1w": "usd_lag_ret", "hl_range_pct": "hl", "hl_range_ma20": "hl20", "usd_rv_5d": "u5", "usd_rv_20d": "u20"}


@query("job_integrate", f"""
 select symbol, d, case when symbol%2=1 then 'corn' else 'coffee' end crop, (r>0.025e0)::double target_binary, case when pd>=pf and pd>=pu then 0e0 when pf>=pu then 1e0 else 2e0 end target_multiclass,
  {', '.join(f'{sround(I_SQL.get(c, c), 5)} {c}' for c in I_OUT)} from i_final""")
def job_integrate(spark, sf):
    out = both_crops(spark, sf, weekly=False)
    return _r(out, ["symbol", "d", "crop", "target_binary", "target_multiclass"], I_OUT, 5)


@query("job_integrate_weekly")
def job_integrate_weekly(spark, sf):
    out = both_crops(spark, sf, weekly=True)
    return out.select("symbol", "d", "crop", *[rounded(c, 5).alias(c) for c, t_ in out.dtypes if t_ == "double"])


# names in the views and in the table
SCANNED = {**{c: c for c in ("high", "low", "close", "volume", *BB, "usd_close", "inf_mom_pct", "cal_sin_week", "vix_regime")}, "usd_lag_ret": "usd_log_return_lag_1w"}
CROP = "case when symbol%2=1 then 'corn' else 'coffee' end"
view("ls_week", f"select {CROP} crop, cast(date_trunc('week', d + 6) as date) d, {', '.join(f'avg({c}) {c}' for c in SCANNED)} from i_carried group by 1,2")
view("ls_rows", f"""
 select *, row_number() over (partition by crop order by d) i, count(*) over (partition by crop) n from
  (select *, lead(close) over (partition by crop order by d)/close-1 y from ls_week) where y is not null and {' and '.join(f'{c} is not null' for c in SCANNED)}""")
view("ls_long", f"unpivot ls_rows on {', '.join(SCANNED)} into name variable value x")
view("ls_static", """
 select a.crop, a.variable, b.i-a.i lag, corr(a.x,b.y) r, count(*) pairs from ls_long a join ls_rows b on a.crop=b.crop and b.i-a.i between 1 and 52 where a.n>=72 group by 1,2,3 having count(*)>=20""")
view("ls_null", f"""
 with l as (select * from ls_rows cross join (select unnest(range(1,53)) lag) where n>=72 and n-lag>=20),
 sx as (select crop, lag, b, {', '.join(SCANNED)}, row_number() over (partition by crop, lag, b order by (((b*7919+(i-1)*104729)%1000003)*((b*31+(i-1)*17+7)%999983)+b*(i-1))%2147483647, i) pos
  from l cross join (select unnest(range(1,{DRAWS + 1})) b) where i<=n-lag),
 sy as (select crop, lag, i-lag pos, y from l where i>lag)
 unpivot (select crop, lag, b, {', '.join(f'coalesce(corr({c},y),2e0) {c}' for c in SCANNED)} from sx join sy using (crop, lag, pos) group by 1,2,3) on {', '.join(SCANNED)} into name variable value r""")
view("ls_p", f"""
 select s.crop, s.variable, s.lag, s.r, coalesce(sum((u.r<2 and abs(u.r)>=abs(s.r))::int),0)/{DRAWS}e0 p from ls_static s join ls_null u using (crop, variable, lag) group by 1,2,3,4""")
view("ls_sig", """
 with s as (select crop, variable, x, y, i-1 i, n from ls_long),
 p as (select a.crop, a.variable, a.i, b.i-a.i lag, a.n, a.x, b.y from s a join s b on a.crop=b.crop and a.variable=b.variable and b.i-a.i between 1 and 37 join ls_p k on k.crop=a.crop and k.variable=a.variable and k.lag=b.i-a.i and k.p<0.05e0),
 w as (select p.*, st*4 st from p join (select unnest(range(0,5000)) st) q on st*4<=i and i<st*4+52-p.lag and st*4<n-52-p.lag)
 select crop, variable, lag, st, corr(x,y) r, count(*) pairs from w group by 1,2,3,4 having count(*)>=15""")
view("ls_class", f"""
 select crop, variable, lag, count(*) windows, count(*) filter (where {p_sql('r', 'pairs')}<0.05) significant from ls_sig group by 1,2,3""")
view("ls_shift", "select crop, variable, lag from ls_class where significant/windows>=0.6e0")


def weekly_rows(spark, sf, bars, shared):
    """Weeks of each crop: means over its symbols of every scanned column, and the next week's return of the mean close. Complete rows only."""
    parts = []
    for crop in ("corn", "coffee"):
        daily, sources, weather_days = crop_sources(spark, sf, crop, bars, shared)
        parts.append(integrate.merged(daily, ["symbol"], sources, weather_days).select(F.lit(crop).alias("crop"), "d", *SCANNED.values()))
    week = F.date_add(F.date_trunc("week", F.date_add("d", 6)).cast("date"), 0)
    weeks = parts[0].unionByName(parts[1]).groupBy("crop", week.alias("d")).agg(*[F.avg(c).alias(c) for c in SCANNED.values()])
    weeks = over_rows(weeks, ["crop"], "d", [labels.forward_return("close", 1, "y")], 0, 1)
    return cut(weeks.na.drop(how="any", subset=["y", *SCANNED.values()]), "scan_weeks")


def scanned_config(spark, sf, bars, shared):
    rows = weekly_rows(spark, sf, bars, shared)
    found, tested = G.scan_all(rows, ["crop"], "d", list(SCANNED.values()), "y", DRAWS)
    return cut(found, "scan_found"), tested


NAMED = "case when variable='usd_lag_ret' then 'usd_log_return_lag_1w' else variable end"


@query("ccf_all_variables", f"select crop, {NAMED} variable, lag, {sround('r')} r, {sround('p')} p from ls_p")
def ccf_all_variables(spark, sf):
    """Correlation and permutation test of every lag of every weekly column, both crops, in one scan."""
    _, tested = scanned_config(spark, sf, *shared_inputs(spark, sf))
    return tested.select("crop", "variable", F.col("lag").cast("long").alias("lag"), rounded("r").alias("r"), rounded("p").alias("p"))


@query("job_integrate_lagged", f"""
 with keyed as (select f.symbol, f.d, {CROP} crop, c.rn from i_final f join i_carried c using (symbol, d)),
 longer as (unpivot (select symbol, rn, {', '.join(f'{c}::double {c}' for c in SCANNED)} from i_carried) on {', '.join(SCANNED)} into name variable value x),
 shifted as (select k.symbol, k.d, k.crop, s.variable, s.lag, l.x from keyed k join ls_shift s using (crop) left join longer l on l.symbol=k.symbol and l.variable=s.variable and l.rn=k.rn-s.lag*5),
 used as (select crop, variable, lag from shifted group by 1,2,3 having count(x)>0),
 whole as (select symbol, d, crop from keyed k where not exists (select 1 from shifted s join used u using (crop, variable, lag) where s.symbol=k.symbol and s.d=k.d and s.x is null))
 select crop, {NAMED} || '_lag_' || lag || 'w' feature, count(*) n, {sround('avg(x)', 4)} mean from shifted join used using (crop, variable, lag) join whole using (symbol, d, crop) group by 1,2""")
def job_integrate_lagged(spark, sf):
    """The integrated table with the lags that the scan found stable: the scan of all weekly columns, its stored verdicts, and the columns
    they ask for. One row per added column, with its rows and mean."""
    bars, shared = shared_inputs(spark, sf)
    found, tested = scanned_config(spark, sf, bars, shared)
    config = cut(G.lag_config(found, tested, ["crop", "variable"]), "lag_config")
    todo, parts = G.actions(config, ["crop"]), []
    for crop in ("corn", "coffee"):
        own = todo.get((crop,), {})
        out = integrated(spark, sf, crop, False, bars, shared, own)
        added = [f"{v}_lag_{k}w" for v, lags in own.items() for k, action in lags.items() if action == "shift_feature"]
        added = [c for c in added if c in out.columns]
        each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in added]) if added else F.array().cast("array<struct<feature:string,x:double>>")
        parts.append(out.select(F.lit(crop).alias("crop"), F.explode(each).alias("f")).select("crop", "f.*"))
    long = parts[0].unionByName(parts[1])
    return long.groupBy("crop", "feature").agg(F.count("x").alias("n"), rounded(F.avg("x"), 4).alias("mean"))


REP = ["corn_planting_pct", "corn_condition_ge_pct", "corn_stress_index"]


@query("job_attach_report_calendar", f"""
 select symbol, d, {sround('ln(close)')} log_close, {', '.join(f'{sround(f"last_value({c} ignore nulls) over ({SYM} rows between unbounded preceding and current row)")} rep_{c}' for c in REP)}
 from i_final left join corn_daily using (d)""")
def job_attach_report_calendar(spark, sf):
    base = both_crops(spark, sf, weekly=False)
    rep = cut(reports.corn_features(report_wide(spark, sf)), "reports")
    out = integrate.attach_reports(base, rep, ["symbol"], weekly=False, replace_calendar=True)
    if any(c.startswith("cal_") for c in out.columns):
        raise AssertionError("calendar columns are still there")
    return out.select("symbol", "d", rounded(F.ln("close")).alias("log_close"), *[rounded(f"rep_{c}").alias(f"rep_{c}") for c in REP])
