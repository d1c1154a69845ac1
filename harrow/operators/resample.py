"""Calendar resampling and long/wide reshaping: one map-side combined aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import closing_monday, spine_of
from ..functions.nullsafe import ratio
from .metrics import quantiles


def aggregate_of(how: str, c: str, d: str) -> Column:
    """first/last skip missing values, like the other aggregates."""
    at = F.when(F.col(c).isNotNull(), F.col(d))
    return {
        "first": lambda: F.min_by(c, at),
        "last": lambda: F.max_by(c, at),
        "max": lambda: F.max(c),
        "min": lambda: F.min(c),
        "sum": lambda: F.coalesce(F.sum(c), F.lit(0)),
        "mean": lambda: F.avg(c),
    }[how]().alias(c)


def to_weeks(
    df: DataFrame,
    keys: list[str],
    d: str,
    how: dict[str, str],
    complete: bool = False,
    every_week: bool = False,
    week: str = "d",
) -> DataFrame:
    """Aggregate to weeks closed by Monday.

    complete drops weeks with a missing value; every_week adds the empty weeks inside each series
    (sums are 0 there, the rest is missing).
    """
    cols = {c: h for c, h in how.items() if c in df.columns}
    out = df.groupBy(*keys, closing_monday(d).alias("__week")).agg(
        *[aggregate_of(h, c, d) for c, h in cols.items()]
    ).withColumnRenamed("__week", week)
    if every_week:
        weeks = spine_of(out, keys, week, 7)
        out = weeks.join(out, [*keys, week], "left")
        out = out.fillna(0, [c for c, h in cols.items() if h == "sum"])
    return out.na.drop(subset=list(cols)) if complete else out


# How each column is brought to weeks.
MARKET_WEEKLY = {
    "open": "first", "high": "max", "low": "min", "close": "last", "volume": "sum",
    "rsi_14": "last", "volatility_20d": "mean", "sma_20": "last", "sma_50": "last", "ema_20": "last",
    "bb_middle": "last", "bb_upper": "last", "bb_lower": "last", "macd": "last", "macd_signal": "last",
    "macd_hist": "last", "momentum_1w": "last", "momentum_1m": "last",
    "close_lag_1w": "last", "close_lag_1m": "last", "log_return_lag_1w": "last", "volatility_lag_1w": "last",
}
WEATHER_WEEKLY = {
    "temp_max": "mean", "temp_min": "mean", "et0": "mean", "vpd_max": "mean",
    "temp_max_rolling_7d": "mean", "temp_max_rolling_14d": "mean", "temp_max_std_7d": "mean",
    "precip_sum_rolling_7d": "mean", "precip_sum_rolling_14d": "mean", "precip_std_7d": "mean",
    "et0_rolling_7d": "mean", "precip": "sum", "dry_days_7d": "last", "temp_max_cumsum_30d": "last",
    "precip_cumsum_30d": "last", "et0_cumsum_30d": "last",
}
BACKBONE_WEEKLY = {
    "temp_max": "mean", "precip": "sum", "et0": "mean", "weekend_temp_max": "mean",
    "weekend_precip_sum": "sum", "weekend_et0": "mean", "hot_day": "sum", "cold_day": "sum",
    "dry_day": "sum", "dry_spell": "last",
}


def regions_to_crop(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Mean over regions per key."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])


def pivot_first(df: DataFrame, keys: list[str], name: str, value: str, names: list, order: str) -> DataFrame:
    """Long to wide, the earliest value by `order` in each cell.

    Every cell is its own conditional aggregate, so the names are fixed and nothing is collected.
    """
    cells = [
        F.min_by(value, F.when((F.col(name) == n) & F.col(value).isNotNull(), F.col(order))).alias(str(n))
        for n in names
    ]
    return df.groupBy(*keys).agg(*cells)


def combine_pairs(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Add two columns with missing as 0, only where both columns exist."""
    zero = F.lit(0)
    return df.withColumns(
        {
            out: F.coalesce(F.col(a), zero) + F.coalesce(F.col(b), zero)
            for out, (a, b) in pairs.items()
            if a in df.columns and b in df.columns
        }
    )


def supply_ratios(df: DataFrame, keys: list[str], year: str) -> DataFrame:
    """Production change, variety shares and stock-to-use, in percent, 0 where undefined.

    The previous year is looked up by an equi join on year + 1, so a gap in years yields 0.
    """
    prev = df.select(*keys, (F.col(year) + 1).alias(year), F.col("production").alias("__prev"))
    out = df.join(prev, [*keys, year], "left")

    def share(num: Column, den: str) -> Column:
        return F.when(F.col(den) > 0, F.coalesce(ratio(num, den) * 100, F.lit(0.0))).otherwise(F.lit(0.0))

    return out.withColumns(
        {
            "change_pct": share(F.col("production") - F.col("__prev"), "__prev"),
            "arabica_pct": share(F.col("arabica"), "production"),
            "robusta_pct": share(F.col("robusta"), "production"),
            "stock_to_use_pct": share(F.col("ending_stocks"), "total_supply"),
        }
    ).drop("__prev")


def fixed_histogram(df: DataFrame, keys: list[str], c: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts per equal bin, closed on the left, the last one on both sides; empty bins included."""
    # Edges are evaluated exactly as lo + i*step; the quotient may be off by one at an edge.
    step = (hi - lo) / bins
    x = F.col(c)
    i = F.floor((x - lo) / step)
    edge = lambda j: j * F.lit(step) + F.lit(lo)
    i = F.when(x < edge(i), i - 1).when(x >= edge(i + 1), i + 1).otherwise(i)
    i = F.least(i, F.lit(bins - 1))
    inside = df.filter((x >= lo) & (x <= hi)).groupBy(*keys, i.cast("int").alias("bin"))
    counts = inside.agg(F.count(F.lit(1)).alias("n"))
    spine = df.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = spine.join(counts, [*keys, "bin"], "left").fillna(0, ["n"])
    return out.withColumn("center", (edge(F.col("bin")) + edge(F.col("bin") + 1)) / 2)


def distribution(df: DataFrame, keys: list[str], r: str, theta: float) -> DataFrame:
    """Flat / positive / negative shares and moments of returns."""
    x = F.col(r)
    known = df.filter(x.isNotNull())
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    moments = known.groupBy(*keys).agg(
        F.count(x).alias("n"),
        share(F.abs(x) <= theta).alias("flat_pct"),
        share(x > theta).alias("pos_pct"),
        share(x < -theta).alias("neg_pct"),
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
    )
    return moments.join(quantiles(known, keys, r, {"median": 0.5, "p5": 0.05, "p95": 0.95}), keys)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the earliest row per key; an aggregate, so duplicates combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*order, *[c for c in rest if c not in order])
    out = df.groupBy(*keys).agg(F.min(row).alias("__row"))
    return out.select(*keys, *[F.col("__row")[c].alias(c) for c in rest])
