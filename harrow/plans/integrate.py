"""Four sources to one labelled feature table per crop and frequency."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.nullsafe import ratio
from ..operators import clean, features, joins, labels
from ..operators.lagscan import shift_layer
from ..operators.ordered import ewm_layers, ewm_reach, over_rows, side_by_side
from ..operators.resample import MARKET_WEEKLY, to_weeks
from . import weather as weather_plan

# Weeks between weather and its effect on the crop.
BIO_LAG_WEEKS = {"coffee": 34, "corn": 9}
TRADING_DAYS = 5
TINY = 1e-8
# Exponential means look back without an end; all other late columns look back on fewer rows than NEAR.
EXPONENTIAL = ["ema_adj", "temp_wavelet_trend", "precip_wavelet_trend"]
NEAR = 64


def merged(market: DataFrame, keys: list[str], sources: dict[str, DataFrame], weather: DataFrame | None) -> DataFrame:
    """Left joins on the exact date with a prefix per source, then the whole frame carried forward.

    Sources without the series keys are dated tables shared by all series; they are bounded by
    the calendar, and Spark broadcasts them when it measures them to be small.
    """
    out = market
    if weather is not None:
        out = out.join(weather, [c for c in (*keys, "d") if c in weather.columns], "left")
    for prefix, src in sources.items():
        on = [c for c in (*keys, "d") if c in src.columns]
        out = out.join(joins.prefixed(src, prefix, on), on, "left")
    return clean.forward_fill(out, keys, "d", [c for c in out.columns if c not in (*keys, "d")])


def integrate(
    market: DataFrame,
    keys: list[str],
    sources: dict[str, DataFrame],
    weather: DataFrame | None = None,
    crop: str = "coffee",
    weekly: bool = False,
    theta: float | None = None,
    lag_actions: dict[str, dict[int, str]] | None = None,
    drop_empty: bool = True,
    first: Column | None = None,
) -> DataFrame:
    """The integrated table: joined sources, price features, forward return and labels.

    `sources` maps prefixes (usd_, inf_, cal_, vix_) to dated tables. Rows with a missing value
    are dropped at the end, columns without any value before that. `first`, a condition on the keys, picks a few series; where they show
    that a column has values, rows without one are dropped as soon as no other row looks at them.
    """
    if weekly:
        how = {c: h for c, h in MARKET_WEEKLY.items() if c != "bb_middle"}
        market = to_weeks(market, keys, "d", how, every_week=True)
        weather = weather_plan.backbone_weekly(weather, []) if weather is not None else None
    df = merged(market, keys, sources, weather)

    n = 4 if weekly else 14
    year = 52 if weekly else 252
    step = 1 if weekly else TRADING_DAYS
    adj = "currency_adjusted_close"
    usd, vol = "usd_close" in df.columns, "volume" in df.columns
    bio = weather is not None and "weekend_temp_max" in df.columns

    def base(c):
        cols = {adj: F.col("close") * F.col("usd_close"), "close_lag_1": R.shift(c, "close", 1), "close_lag_2": R.shift(c, "close", 2)}
        if "usd_log_return_lag_1w" in df.columns and "inf_mom_pct" in df.columns:
            cols["inflation_pressure"] = F.col("usd_log_return_lag_1w") * 100 - F.col("inf_mom_pct")
        if bio:
            back = BIO_LAG_WEEKS[crop] * step
            cols["temp_bio_lag"] = R.shift(c, "weekend_temp_max", back)
            cols["precip_bio_lag"] = R.shift(c, "weekend_precip_sum", back)
        if lag_actions:
            known = {v: a for v, a in lag_actions.items() if v in df.columns}
            cols |= {name: x for name, x in shift_layer(known, step)(c).items() if name not in df.columns}
        return cols

    def start(c):
        cols = {"hl_range_pct": ratio(F.col("high") - F.col("low"), "close")}
        if vol:
            cols["volume_ratio"] = ratio("volume", R.mean(c, "volume", 20) + TINY)
            cols["__dvol"] = R.change(c, "volume")
        if usd:
            cols["__usd_ret"] = R.log_return(c, "usd_close")
        return cols

    def second(c):
        _, up, low = R.bollinger(c, adj, n)
        cols = {
            "bb_upper_adj": up, "bb_lower_adj": low, "volatility": R.std(c, adj, n),
            "__ret": R.log_return(c, adj),
            "hl_range_ma5": R.mean(c, "hl_range_pct", 5), "hl_range_ma20": R.mean(c, "hl_range_pct", 20),
        }
        if usd:
            cols |= {f"usd_rv_{k}d": R.annualised(c, "__usd_ret", k, year) for k in (5, 20)}
        return cols | labels.forward_return(adj, labels.horizon(weekly))(c)

    def third(c):
        cols = {f"rv_{k}d": R.annualised(c, "__ret", k, year) for k in (5, 10, 20)}
        cols["hl_expansion"] = ratio("hl_range_pct", F.col("hl_range_ma20") + TINY)
        if vol:
            cols["price_vol_corr"] = R.corr(c, "__ret", "__dvol", 10)
        if usd:
            cols["usd_rv_ratio"] = ratio("usd_rv_5d", F.col("usd_rv_20d") + TINY)
        return cols

    last = lambda c: {"rv_ratio": ratio("rv_5d", F.col("rv_20d") + TINY)}
    far = [base, *ewm_layers("ema_adj", adj, n)]
    near = side_by_side([start, second, third, last], [lambda c: {}, *R.rsi_layers("rsi_adj", adj, n)])
    longest = max((weeks for lags in (lag_actions or {}).values() for weeks in lags), default=0)
    reach = max(ewm_reach(30), BIO_LAG_WEEKS[crop] * step, longest * step) + 64
    if bio:
        trends = side_by_side(
            ewm_layers("temp_wavelet_trend", "weekend_temp_max", 30, adjust=False),
            ewm_layers("precip_wavelet_trend", "weekend_precip_sum", 30, adjust=False),
        )
        far = side_by_side(far, trends)
    # columns that no layer looks at travel as one, so that windows and sorts copy them as a block
    used = {*keys, "d", "close", "high", "low", "volume", "usd_close", "usd_log_return_lag_1w", "inf_mom_pct", *weather_plan.WEEKEND, *(lag_actions or {})}
    limit = theta if theta is not None else labels.threshold(crop, weekly)

    def built(df: DataFrame, known: set[str] = frozenset()) -> tuple[DataFrame, list[str]]:
        """The table of the rows of `df`, and its near columns. Rows that no complete row looks at are left out between far and near layers: complete
        rows have values in the columns `known`."""
        rest = [c for c in df.columns if c not in used]
        packed = df.select(*[c for c in df.columns if c in used], *([F.struct(*rest).alias("__rest")] if rest else []))
        out = over_rows(packed, keys, "d", far, before=reach, segmented=True)
        early = [c for c in out.columns if c not in packed.columns]
        closer = lambda rows: over_rows(rows, keys, "d", near, before=NEAR, after=labels.horizon(weekly))
        late = [c for c in closer(out).columns if c not in out.columns]
        if known:
            sofar = {c: f"__rest.{c}" if c in rest and c not in early else c for c in [*df.columns, *early] if c not in late}
            out = looked_at(out, keys, [at for c, at in sofar.items() if c in known], NEAR, labels.horizon(weekly))
        means = [c for c in early if c in EXPONENTIAL]
        added = [*[c for c in early if c not in means], *late, *means]
        out = closer(out).select(*[F.col(f"__rest.{c}").alias(c) if c in rest else c for c in df.columns if c not in added], *added)
        named = labels.all_labels("return_future", limit)
        return out.withColumns(named), [*late, *named]

    out, late = built(df)
    if not drop_empty:
        return out.na.drop(how="any")
    # what has a value in the first series has one; rows that miss it are not needed, if all near columns are among it
    known = features.columns_with_values(built(df.filter(first))[0]) if first is not None else set()
    if known.issuperset(late):
        return features.complete_but_empty(built(df, known)[0], known, "integrated", out)
    return features.complete_but_empty(out, known, "integrated")


def looked_at(df: DataFrame, keys: list[str], columns: list[str], before: int, after: int) -> DataFrame:
    """Rows of a series from `before` rows before its first row with values in all `columns` to `after` rows after its last one."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    w, ordered = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("d")
    at = F.when(whole, F.col("__at"))
    out = df.withColumn("__at", F.row_number().over(ordered)).withColumns({"__lo": F.min(at).over(w), "__hi": F.max(at).over(w)})
    return out.filter(F.col("__at").between(F.col("__lo") - before, F.col("__hi") + after)).drop("__at", "__lo", "__hi")


def attach_reports(integrated: DataFrame, reports: DataFrame, keys: list[str], weekly: bool, replace_calendar: bool) -> DataFrame:
    """Report features joined by date (weekly means when weekly) and carried forward.

    replace_calendar drops the synthetic calendar columns first.
    """
    out = features.drop_by_prefix(integrated, "cal_") if replace_calendar else integrated
    rep = joins.prefixed(reports, "rep_", ["d"])
    if weekly:
        rep = to_weeks(rep, [], "d", {c: "mean" for c in features.feature_columns(rep)})
    out = out.join(rep, "d", "left")
    return clean.forward_fill(out, keys, "d", [c for c in out.columns if c not in (*keys, "d")])


