"""Anomaly removal and gap filling on ordered series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.calendar import spine_of
from ..functions.nullsafe import flag
from .ordered import Run, numbered, over_rows, running


def iqr_outliers(df, keys, order, cols, window=15, k=3.0, **kw) -> DataFrame:
    """Add `<col>_spike` flags: outside the trailing quartile fence."""
    layer = lambda c: {f"{x}_spike": R.iqr_outlier(c, x, window, k) for x in cols}
    return over_rows(df, keys, order, [layer], before=window - 1, **kw)


def run_totals(df, keys, order, flags: list[str], **kw) -> DataFrame:
    """Add `<flag>_run`: full length of the run of ones a row lies in, 0 outside runs.

    A run ends where the flag is not 1, so its length follows from the row numbers of the nearest
    such rows on both sides; no group per run is formed, however long a run gets.
    """
    p = numbered(df, keys, order, "__len", **kw)
    gaps = {f: F.when(F.coalesce(F.col(f), F.lit(0)) != 1, F.col("__pos")) for f in flags}
    specs = {f"__b_{f}": Run("last", g) for f, g in gaps.items()}
    specs |= {f"__a_{f}": Run("first", g) for f, g in gaps.items()}
    out = running(p, keys, order, specs, **kw)
    total = {
        f"{f}_run": F.when(
            F.col(f) == 1,
            F.coalesce(F.col(f"__a_{f}"), F.col("__len") + 1)
            - F.coalesce(F.col(f"__b_{f}"), F.lit(0)) - 1,
        ).otherwise(F.lit(0)).cast("long")
        for f in flags
    }
    return out.withColumns(total).drop("__pos", "__len", *specs)


def run_length(df, keys, order, flags: list[str], suffix: str = "_run", **kw) -> DataFrame:
    """Add `<flag>_run`: number of consecutive ones up to and including the row."""
    p = numbered(df, keys, order, **kw)
    specs = {
        f"__b_{f}": Run("last", F.when(F.coalesce(F.col(f), F.lit(0)) != 1, F.col("__pos"))) for f in flags
    }
    out = running(p, keys, order, specs, **kw)
    length = {
        f"{f}{suffix}": F.when(F.col(f) == 1, F.col("__pos") - F.coalesce(F.col(f"__b_{f}"), F.lit(0)))
        .otherwise(F.lit(0))
        .cast("long")
        for f in flags
    }
    return out.withColumns(length).drop("__pos", *specs)


def drop_isolated_spikes(df, keys, order, cols, window=15, k=3.0, sustained=7, **kw) -> DataFrame:
    """Null out outliers, except runs of at least `sustained` rows, which are real events."""
    flagged = iqr_outliers(df, keys, order, cols, window, k, **kw)
    counted = run_totals(flagged, keys, order, [f"{c}_spike" for c in cols], **kw)
    isolated = {
        c: F.when((F.col(f"{c}_spike") == 1) & (F.col(f"{c}_spike_run") < sustained), None).otherwise(F.col(c))
        for c in cols
    }
    return counted.withColumns(isolated).select(*df.columns)


def dead_sensor_layers(cols, window=5, eps=1e-4, dead=4):
    """Layers for `<col>_dead`: the short rolling deviation stayed below eps for `dead` rows.

    Frames with fewer than two known values have no deviation and count as flat.
    """

    def flat(ctx):
        return {
            f"__flat_{c}": flag(
                F.coalesce(F.stddev_samp(c).over(ctx.back(window)), F.lit(0.0)) < eps
            )
            for c in cols
        }

    def stuck(ctx):
        return {f"{c}_dead": flag(F.sum(f"__flat_{c}").over(ctx.back(dead)) >= dead) for c in cols}

    return [flat, stuck]


def drop_dead_sensor(df, keys, order, cols, window=5, eps=1e-4, dead=4, **kw) -> DataFrame:
    """Null out rows of a stuck sensor; series without any value are left alone."""
    layers = dead_sensor_layers(cols, window, eps, dead)
    out = over_rows(df, keys, order, layers, before=window + dead, **kw)
    cut = {c: F.when(F.col(f"{c}_dead") == 1, None).otherwise(F.col(c)) for c in cols}
    return out.withColumns(cut).select(*df.columns)


def despike(df, keys, order, limits: dict[str, object], **kw) -> DataFrame:
    """Null out V-shaped spikes of each column and interpolate over them."""
    marks = over_rows(
        df, keys, order,
        [lambda c: {f"{x}_spike": R.spike(c, x, lim) for x, lim in limits.items()}],
        before=1, after=1, **kw,
    )
    cut = marks.withColumns({x: F.when(F.col(f"{x}_spike") == 1, None).otherwise(F.col(x)) for x in limits})
    return interpolate(cut, keys, order, list(limits), **kw).select(*df.columns)


def interpolate(df, keys, order, cols, **kw) -> DataFrame:
    """Linear by row position; a trailing gap repeats the last value, a leading gap stays."""
    p = numbered(df, keys, order, **kw)
    known = {
        c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col("__pos").alias("at"))) for c in cols
    }
    specs = {f"__b_{c}": Run("last", s) for c, s in known.items()}
    specs |= {f"__a_{c}": Run("first", s) for c, s in known.items()}
    out = running(p, keys, order, specs, **kw)

    def fill(c: str):
        b, a = F.col(f"__b_{c}"), F.col(f"__a_{c}")
        slope = F.try_divide(a["v"] - b["v"], a["at"] - b["at"])
        return F.coalesce(F.col(c), b["v"] + slope * (F.col("__pos") - b["at"]), b["v"])

    return out.withColumns({c: fill(c) for c in cols}).select(*df.columns)


def forward_fill(df, keys, order, cols, **kw) -> DataFrame:
    return running(df, keys, order, {c: Run("last", F.col(c)) for c in cols}, **kw).select(*df.columns)


def back_fill(df, keys, order, cols, **kw) -> DataFrame:
    """Fill a gap from the next known value. This looks ahead; use only where that is intended."""
    return running(df, keys, order, {c: Run("first", F.col(c)) for c in cols}, **kw).select(*df.columns)


def fill_constant(df, values: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def densify_daily(df, keys, d, cols, carry: bool = True) -> DataFrame:
    """One row per day between the ends of each series; values carried forward."""
    out = spine_of(df, keys, d).join(df, [*keys, d], "left")
    return forward_fill(out, keys, d, cols) if carry else out


