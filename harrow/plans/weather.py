"""Station tables to weather features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.calendar import closing_monday, is_weekend
from ..functions.nullsafe import flag
from ..operators import clean, features
from ..operators.ordered import over_rows
from ..operators.resample import BACKBONE_WEEKLY, WEATHER_WEEKLY, regions_to_crop, to_weeks

SENSORS = ["temp_max", "temp_min", "et0", "vpd_max"]
WEEKEND = ["weekend_temp_max", "weekend_precip_sum", "weekend_et0"]


def cleaned(df: DataFrame, keys: list[str]) -> DataFrame:
    """Isolated spikes and stuck sensors nulled in the four measured columns; rain untouched."""
    cols = [c for c in SENSORS if c in df.columns]
    out = clean.drop_isolated_spikes(df, keys, "d", cols, window=15, k=3.0, sustained=7)
    return clean.drop_dead_sensor(out, keys, "d", cols, window=5, eps=1e-4, dead=4)


def station_features(df: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps filled, thirteen rolling features per station, incomplete rows dropped."""
    filled = clean.forward_fill(df, keys, "d", [c for c in SENSORS if c in df.columns])
    filled = clean.fill_constant(filled, {"precip": 0.0})

    def layer(c):
        t, p, e = "temp_max", "precip", "et0"
        return {
            "temp_max_rolling_7d": R.mean(c, t, 7),
            "temp_max_rolling_14d": R.mean(c, t, 14),
            "temp_max_cumsum_30d": R.total(c, t, 30),
            "temp_max_diff_1d": R.diff(c, t),
            "temp_max_std_7d": R.std(c, t, 7),
            "precip_sum_rolling_7d": R.total(c, p, 7),
            "precip_sum_rolling_14d": R.total(c, p, 14),
            "precip_cumsum_30d": R.total(c, p, 30),
            "precip_diff_1d": R.diff(c, p),
            "precip_std_7d": R.std(c, p, 7),
            "dry_days_7d": flag(R.total(c, p, 7) == 0),
            "et0_rolling_7d": R.mean(c, e, 7),
            "et0_cumsum_30d": R.total(c, e, 30),
        }

    return over_rows(filled, keys, "d", [layer], before=30).na.drop(how="any")


def weekly(df: DataFrame, keys: list[str]) -> DataFrame:
    return to_weeks(df, keys, "d", WEATHER_WEEKLY, complete=True)


def weekend_features(df: DataFrame, keys: list[str]) -> DataFrame:
    """Weekend means and rain sum, available from the Monday after, carried forward."""
    agg = (
        df.filter(is_weekend("d"))
        .groupBy(*keys, closing_monday("d").alias("d"))
        .agg(
            F.avg("temp_max").alias(WEEKEND[0]),
            F.sum("precip").alias(WEEKEND[1]),
            F.avg("et0").alias(WEEKEND[2]),
        )
    )
    return clean.forward_fill(df.join(agg, [*keys, "d"], "left"), keys, "d", WEEKEND)


def backbone(df: DataFrame, keys: list[str], region: str = "region") -> DataFrame:
    """Smoothed, weekend-enriched, flagged stations averaged over regions per key and day."""
    series = [*keys, region]
    smooth = over_rows(
        df, series, "d",
        [lambda c: {"sm_precip": R.mean_partial(c, "precip", 7), "sm_et0": R.mean_partial(c, "et0", 7)}],
        before=7,
    )
    smooth = smooth.withColumns({"precip": F.col("sm_precip"), "et0": F.col("sm_et0")}).drop("sm_precip", "sm_et0")
    out = features.day_flags(weekend_features(smooth, series))
    out = clean.run_length(out, series, "d", ["dry_day"]).withColumnRenamed("dry_day_run", "dry_spell")
    values = [c for c in out.columns if c not in (*series, "d")]
    return regions_to_crop(out, [*keys, "d"], values)


def backbone_weekly(df: DataFrame, keys: list[str]) -> DataFrame:
    return to_weeks(df, keys, "d", BACKBONE_WEEKLY, every_week=True)
