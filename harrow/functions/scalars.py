"""Row-level formulas: encodings, squashing, labels and verdicts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nullsafe import col, is_true

# Ordinal codes of report labels.
CORN_SIGNALS = {
    "very_delayed_very_bearish": -2,
    "delayed_bearish": -1,
    "on_track": 0,
    "condition_deteriorating": -1,
    "condition_improving": 1,
    "ahead_bullish": 2,
}
COFFEE_SIGNALS = {
    "severe_stress_very_bearish": -2,
    "crop_stress_bearish": -1,
    "below_average": -1,
    "on_track": 0,
    "above_average": 1,
    "bumper_crop_bullish": 2,
}
COFFEE_STAGES = ["dormancy", "flowering", "fruit_development", "maturation", "harvest", "post_harvest"]
CONDITIONS = ["very_poor", "poor", "fair", "good", "excellent"]


def cyclic(c: str | Column, period: int) -> tuple[Column, Column]:
    """(sin, cos) of a position on a cycle."""
    angle = col(c) * F.lit(2 * math.pi) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def clamp(c: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Clamp, leaving null as null (greatest/least alone would skip it)."""
    c = col(c)
    out = c
    if hi is not None:
        out = F.least(out, F.lit(hi))
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    return F.when(c.isNotNull(), out)


def bucket_of(c: str | Column, edges: list[float]) -> Column:
    """Index of the half-open bin (edge[i], edge[i+1]] holding c; null outside."""
    c = col(c)
    out = F.lit(None).cast("double")
    for i in reversed(range(len(edges) - 1)):
        out = F.when((c > edges[i]) & (c <= edges[i + 1]), F.lit(float(i))).otherwise(out)
    return out


def argmax(scores: list[str | Column]) -> Column:
    """Position of the largest score; the first one wins a tie; null if any is missing."""
    arr = F.array(*[col(s) for s in scores])
    known = ~F.exists(arr, lambda v: v.isNull())
    return F.when(known, F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def code_of(c: str | Column, codes: dict[str, int] | list[str], default: int | None = None) -> Column:
    """Ordinal code of a label, `default` for unknown labels."""
    if isinstance(codes, list):
        codes = {name: i for i, name in enumerate(codes)}
    out = F.lit(default).cast("int")
    for name, code in codes.items():
        out = F.when(col(c) == name, F.lit(code)).otherwise(out)
    return out


# Limits and labels, first match wins; the last entry has no limit.
PROGRESS_GAP = [("ge", 5, "ahead_bullish"), ("le", -15, "very_delayed_very_bearish"), ("le", -5, "delayed_bearish")]
PROGRESS_POOR = [("ge", 30, "condition_deteriorating"), ("le", 10, "condition_improving"), (None, None, "on_track")]
PRODUCTION_CHANGE = [("ge", 10, "bumper_crop_bullish"), ("ge", 3, "above_average"), ("le", -10, "crop_stress_bearish"), ("le", -3, "below_average"), (None, None, "on_track")]
COST_SHARPE = [("ge", 1.5, "Robust"), ("ge", 0.8, "Acceptable"), ("ge", 0.0, "Degraded"), (None, None, "Negative")]
COST_NONE = "Baseline"
# Thirds of the years that have to be good.
GATE_THIRDS = [("ge", 2, "VIABLE"), ("ge", 1, "MARGINAL"), (None, None, "WEAK")]
# Sources by the start of a feature's name, and names that stand for themselves.
GROUP_PREFIXES = [
    ("macro", ["usd_", "vix_", "inf_"]), ("farming", ["cal_"]),
    ("weather", ["temperature_", "precipitation_", "et0_", "vpd_", "weekend_", "precip_", "temp_"])]
GROUP_NAMES = {"is_harvest": "farming", "is_planting": "farming"}
GROUP_OTHER = "market"


def tiers(x: Column, table: list[tuple], otherwise: Column | None = None, scale: Column | int = 1) -> Column:
    """The label of the first limit that x reaches (ge) or does not exceed (le); unknown values reach none."""
    out = otherwise if otherwise is not None else F.lit(None).cast("string")
    for side, limit, label in reversed(table):
        if side is None:
            out = F.lit(label)
            continue
        edge = F.lit(limit) * scale
        out = F.when(is_true(x >= edge if side == "ge" else x <= edge), label).otherwise(out)
    return out


def progress_signal(planting_gap: Column, poor_share: Column) -> Column:
    """Planting gap decides first, then the poor-condition share, else on track."""
    return tiers(planting_gap, PROGRESS_GAP, tiers(poor_share, PROGRESS_POOR))


def production_signal(change_pct: Column) -> Column:
    return tiers(change_pct, PRODUCTION_CHANGE)


def cost_verdict(cost: Column, sharpe: Column) -> Column:
    """Label a Sharpe ratio after costs; an undefined one falls through to the last label."""
    return F.when(cost == 0, COST_NONE).otherwise(tiers(sharpe, COST_SHARPE))


def gate_verdict(good: Column, total: Column) -> Column:
    """Share of good years against thirds, compared in integers."""
    return tiers(good * 3, GATE_THIRDS, scale=total)


def feature_group(name: str | Column) -> Column:
    """Which source a feature comes from, by its name."""
    n = F.lower(col(name))
    out = F.lit(GROUP_OTHER)
    for group, prefixes in reversed(GROUP_PREFIXES):
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | n.startswith(p)
        out = F.when(hit, group).otherwise(out)
    for own, group in GROUP_NAMES.items():
        out = F.when(n == own, group).otherwise(out)
    return out
