"""Currency, inflation and volatility-index features."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.calendar import release_date
from ..functions.scalars import bucket_of
from ..operators import clean
from ..operators.ordered import over_rows, side_by_side
from ..operators.resample import to_weeks
from .market import SPIKE_LIMIT, despiked

# Volatility regimes and weekly aggregates of the currency table.
REGIMES = [0, 15, 25, 999]
FX_WEEKLY = {
    "open": "first", "high": "max", "low": "min", "close": "last", "volume": "sum", "rsi_14": "last",
    "volatility_20d": "mean", "close_lag_1w": "last", "close_lag_1m": "last",
    "log_return_lag_1w": "last", "volatility_lag_1w": "last",
}
INDEX = ["v", "mom_pct", "yoy_pct"]


def fx_daily(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Despiked currency bars with RSI (50 where undefined), volatility and four lags.

    Lags are taken on the complete rows, so they count rows after the warm-up is dropped.
    """
    base = despiked(bars, keys, SPIKE_LIMIT["fx"])
    layers = side_by_side(
        [
            lambda c: {"log_return": R.log_return(c, "close")},
            lambda c: {"volatility_20d": R.std(c, "log_return", 20) * math.sqrt(252)},
        ],
        R.rsi_layers("rsi_14", "close", 14),
    )
    out = clean.fill_constant(over_rows(base, keys, "d", layers, before=21), {"rsi_14": 50.0}).na.drop(how="any")

    def lags(c):
        return {
            "close_lag_1w": R.shift(c, "close", 5),
            "close_lag_1m": R.shift(c, "close", 21),
            "log_return_lag_1w": R.shift(c, "log_return", 5),
            "volatility_lag_1w": R.shift(c, "volatility_20d", 5),
        }

    return over_rows(out, keys, "d", [lags], before=21)


def fx_weekly(bars: DataFrame, keys: list[str]) -> DataFrame:
    return to_weeks(fx_daily(bars, keys), keys, "d", FX_WEEKLY, complete=True)


def inflation_daily(monthly: DataFrame, keys: list[str]) -> DataFrame:
    """Index and its 1- and 12-month changes on every day from the release of each month on.

    Changes are computed on the months, before days are filled.
    """
    filled = monthly.withColumn("__f", F.col("v"))
    filled = clean.forward_fill(filled, keys, "d", ["__f"])
    changes = over_rows(
        filled, keys, "d",
        [lambda c: {"mom_pct": R.change(c, "__f", 1) * 100, "yoy_pct": R.change(c, "__f", 12) * 100}],
        before=12,
    ).drop("__f")
    released = changes.withColumn("d", release_date("d"))
    return clean.densify_daily(released, keys, "d", INDEX)


def inflation_weekly(monthly: DataFrame, keys: list[str]) -> DataFrame:
    return to_weeks(inflation_daily(monthly, keys), keys, "d", {c: "last" for c in INDEX}, complete=True)


def volatility_weekly(index: DataFrame, keys: list[str]) -> DataFrame:
    """Weekly close of a volatility index with return, 4-week mean and regime."""
    weeks = to_weeks(index, keys, "d", {"close": "last"}, every_week=True)
    out = over_rows(
        weeks, keys, "d",
        [lambda c: {"log_return": R.log_return(c, "close"), "ma4": R.mean(c, "close", 4)}],
        before=4,
    )
    return out.withColumn("regime", bucket_of("close", REGIMES)).na.drop(how="any")
