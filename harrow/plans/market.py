"""Raw bars to cleaned daily and weekly market features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..operators import clean, features
from ..operators.ordered import ewm_layers, ewm_reach, over_rows, side_by_side
from ..operators.resample import MARKET_WEEKLY, to_weeks

# Spike limits.
SPIKE_LIMIT = {"coffee": 0.06, "corn": 0.05, "fx": 0.03}


def despiked(bars: DataFrame, keys: list[str], limit: float | Column) -> DataFrame:
    """Spikes removed from close, high and low; high and low made consistent with the close."""
    out = clean.despike(bars, keys, "d", {"close": limit, "high": limit, "low": limit})
    return features.ohlc_consistent(out)


def daily_features(bars: DataFrame, keys: list[str], limit: float | Column) -> DataFrame:
    """Fourteen price features on despiked bars, complete rows only."""
    c = "close"
    first = lambda ctx: {"log_return": R.log_return(ctx, c)}

    def rest(ctx):
        mid, up, low = R.bollinger(ctx, c, 20)
        return {
            "volatility_20d": R.std(ctx, "log_return", 20) * math.sqrt(252),
            "sma_20": R.mean(ctx, c, 20),
            "sma_50": R.mean(ctx, c, 50),
            "bb_middle": mid,
            "bb_upper": up,
            "bb_lower": low,
            "momentum_1w": R.change(ctx, c, 5),
            "momentum_1m": R.change(ctx, c, 21),
        }

    layers = side_by_side(
        [first, rest], R.rsi_layers("rsi_14", c, 14, zero_loss="limit"), ewm_layers("ema_20", c, 20), R.macd_layers(c)
    )
    reach = ewm_reach(26) + ewm_reach(9) + 50
    return over_rows(despiked(bars, keys, limit), keys, "d", layers, before=reach, segmented=True).na.drop(how="any")


def weekly_features(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Indicators are the last daily value of the week, not recomputed."""
    return to_weeks(daily, keys, "d", MARKET_WEEKLY, complete=True)
