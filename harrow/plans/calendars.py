"""Crop calendars: weekly flags, stage durations, cyclic codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cyclic
from ..operators.clean import run_length
from ..operators.resample import to_weeks


def weekly_flags(df: DataFrame, keys: list[str], d: str, flags: list[str]) -> DataFrame:
    """Weekly maximum of 0/1 flags; weeks without rows are 0."""
    out = to_weeks(df, keys, d, {f: "max" for f in flags}, every_week=True, week=d)
    return out.fillna(0, flags)


def cyclic_codes(df: DataFrame, d: str = "d") -> DataFrame:
    """Month and ISO week on their cycles."""
    sin_m, cos_m = cyclic(F.month(d), 12)
    sin_w, cos_w = cyclic(F.weekofyear(d), 52)
    return df.withColumns(
        {
            "month": F.month(d),
            "week_of_year": F.weekofyear(d),
            "sin_month": sin_m,
            "cos_month": cos_m,
            "sin_week": sin_w,
            "cos_week": cos_w,
        }
    )


def calendar_features(df: DataFrame, keys: list[str], d: str = "d") -> DataFrame:
    """Daily stage flags to weekly flags, durations and cyclic codes."""
    flags = [c for c in df.columns if c.startswith("is_")]
    weeks = weekly_flags(df, keys, d, flags)
    return cyclic_codes(run_length(weeks, keys, d, flags, suffix="_duration"), d)
