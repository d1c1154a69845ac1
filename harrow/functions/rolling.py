"""Window expressions for ordered series.

Every function takes the layer context of ``operators.ordered`` and returns a column. Frames are
trailing (never centred), so a feature at row t uses rows up to t only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.ordered import Ctx, Layer, ewm_layers, side_by_side
from .nullsafe import both, col, flag, ratio


def full(ctx: Ctx, agg: Callable[[Column], Column], c: str | Column, n: int) -> Column:
    """agg over the last n rows, null until the frame holds n known values."""
    c = col(c)
    frame = ctx.back(n)
    return F.when(F.count(c).over(frame) >= n, agg(c).over(frame))


def mean(ctx: Ctx, c: str | Column, n: int) -> Column:
    return full(ctx, F.avg, c, n)


def total(ctx: Ctx, c: str | Column, n: int) -> Column:
    return full(ctx, F.sum, c, n)


def std(ctx: Ctx, c: str | Column, n: int) -> Column:
    """Sample standard deviation."""
    return full(ctx, F.stddev_samp, c, n)


def mean_partial(ctx: Ctx, c: str | Column, n: int) -> Column:
    """Mean over whatever part of the frame exists."""
    return F.avg(col(c)).over(ctx.back(n))


def shift(ctx: Ctx, c: str | Column, n: int) -> Column:
    """Value n rows ago; n < 0 looks ahead."""
    return F.lag(col(c), n).over(ctx.w) if n >= 0 else F.lead(col(c), -n).over(ctx.w)


def diff(ctx: Ctx, c: str | Column, n: int = 1) -> Column:
    return col(c) - shift(ctx, c, n)


def change(ctx: Ctx, c: str | Column, n: int = 1) -> Column:
    """Relative change against the value n rows ago."""
    return ratio(c, shift(ctx, c, n)) - 1


def log_return(ctx: Ctx, c: str | Column) -> Column:
    r = ratio(c, shift(ctx, c, 1))
    return F.when(r > 0, F.ln(r))


def corr(ctx: Ctx, x: str | Column, y: str | Column, n: int) -> Column:
    """Pearson r over the last n rows; needs n complete pairs, null for a constant side."""
    x, y = both(x, y)
    frame = ctx.back(n)
    spread = F.stddev_samp(x).over(frame) * F.stddev_samp(y).over(frame)
    r = F.try_divide(F.covar_samp(x, y).over(frame), spread)
    return F.when(F.count(x).over(frame) >= n, r)


def spike(ctx: Ctx, c: str, limit: float) -> Column:
    """V-shaped jump: large relative moves to both neighbours, in opposite directions."""
    back, ahead = diff(ctx, c), shift(ctx, c, -1) - F.col(c)
    big_in = F.abs(ratio(back, shift(ctx, c, 1))) > limit
    big_out = F.abs(ratio(ahead, c)) > limit
    return flag(big_in & big_out & (back * ahead < 0))


def iqr_outlier(ctx: Ctx, c: str, n: int = 15, k: float = 3.0) -> Column:
    """Outside the trailing quartiles by more than k interquartile ranges."""
    frame = ctx.back(n)
    q1 = F.percentile(c, 0.25).over(frame)
    q3 = F.percentile(c, 0.75).over(frame)
    iqr = q3 - q1
    return flag((F.col(c) < q1 - k * iqr) | (F.col(c) > q3 + k * iqr))


def rsi_layers(out: str, c: str, n: int = 14, zero_loss: str = "null") -> list[Layer]:
    """Relative strength index.

    zero_loss='null' treats a window without losses as unknown; 'limit' gives 100 (and null
    where there were no gains either). The missing first difference counts as no move.
    """
    up, down = f"__up_{out}", f"__down_{out}"

    def moves(ctx: Ctx) -> dict[str, Column]:
        d = diff(ctx, c)
        zero = F.lit(0.0)
        return {up: F.when(d > 0, d).otherwise(zero), down: F.when(d < 0, -d).otherwise(zero)}

    def index(ctx: Ctx) -> dict[str, Column]:
        gain, loss = mean(ctx, up, n), mean(ctx, down, n)
        value = 100 - 100 / (1 + F.try_divide(gain, loss))
        if zero_loss == "limit":
            value = F.when((loss == 0) & (gain > 0), F.lit(100.0)).otherwise(value)
        return {out: value}

    return [moves, index]


def macd_layers(c: str) -> list[Layer]:
    """MACD line, its 9-row signal and their difference."""

    def line(ctx: Ctx) -> dict[str, Column]:
        return {"macd": F.col("__ema_12") - F.col("__ema_26")}

    def hist(ctx: Ctx) -> dict[str, Column]:
        return {"macd_hist": F.col("macd") - F.col("macd_signal")}

    return [
        *side_by_side(ewm_layers("__ema_12", c, 12), ewm_layers("__ema_26", c, 26)),
        line,
        *ewm_layers("macd_signal", "macd", 9),
        hist,
    ]


def bollinger(ctx: Ctx, c: str | Column, n: int = 20, k: float = 2.0) -> tuple[Column, Column, Column]:
    """(middle, upper, lower) band."""
    mid, dev = mean(ctx, c, n), std(ctx, c, n)
    return mid, mid + k * dev, mid - k * dev


def annualised(ctx: Ctx, log_ret: str, n: int, periods: int) -> Column:
    return std(ctx, log_ret, n) * math.sqrt(periods)
