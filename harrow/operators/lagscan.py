"""Lag scans: which past values of a variable move with a target.

Series are weekly tables keyed by `keys` and ordered by a DATE, so a series is calendar-bounded;
the work spreads over (series, lag), (series, lag, draw) and (series, lag, window).
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rolling as R
from ..functions.nullsafe import pearson
from ..sources.sinks import cut
from .ordered import over_rows, positions
from .splits import draw_key, permuted_arrays

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Scan settings.
MAX_LAG = 52
DRAWS = 300
WINDOW, STEP = 52, 4
ALPHA, STABLE_SHARE = 0.05, 0.6
MIN_PAIRS, MIN_WINDOW_PAIRS = 20, 15
#: Positions of shuffles that a task keeps.
KEPT_CELLS = 1 << 23


def shift_layer(actions: dict[str, dict[int, str]], rows_per_week: int):
    """Layer adding `<var>_lag_<k>w` for every lag the scan marked as a stable feature."""

    def layer(ctx):
        return {
            f"{var}_lag_{weeks}w": R.shift(ctx, var, weeks * rows_per_week)
            for var, lags in actions.items()
            for weeks, action in lags.items()
            if action == "shift_feature"
        }

    return layer


def complete_pairs(df: DataFrame, keys: list[str], d: str, x: str, y: str, max_lag: int = MAX_LAG) -> DataFrame:
    """Rows with both values, of series long enough for the scan, with position and length."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return positions(pairs, keys, d, "rn", "n").filter(F.col("n") >= max_lag + MIN_PAIRS)


def static_scan(df: DataFrame, keys: list[str], d: str, x: str, y: str, max_lag: int = MAX_LAG) -> DataFrame:
    """(keys, lag, r, pairs): correlation of x[t-lag] with y[t] for lags 1..max_lag.

    One window pass hands each row its last max_lag values of x; they are unrolled and aggregated
    map-side, so lags are neither joined nor shuffled as rows.
    """
    rows = complete_pairs(df, keys, d, x, y, max_lag)
    past = over_rows(
        rows, keys, d,
        [lambda c: {"past": F.collect_list(x).over(c.w.rowsBetween(-max_lag, -1))}],
        before=max_lag,
    )
    size = F.size("past")
    long = past.select(*keys, y, size.alias("m"), F.posexplode("past").alias("i", "x_lag"))
    out = long.groupBy(*keys, (F.col("m") - F.col("i")).alias("lag")).agg(
        pearson("x_lag", y).alias("r"), F.count(F.lit(1)).alias("pairs")
    )
    return out.filter(F.col("pairs") >= MIN_PAIRS)


def per_variable(df: DataFrame, keys: list[str], d: str, variables: list[str], y: str) -> DataFrame:
    """Long form (keys, variable, d, x, y), which every scan takes with the variable as a key."""
    pairs = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"`{v}`").cast("double").alias("x")) for v in variables])
    return df.select(*keys, d, y, F.explode(pairs).alias("p")).select(*keys, "p.variable", d, "p.x", F.col(y).alias("y"))


def shared_null_scan(df: DataFrame, keys: list[str], d: str, variables: list[str], y: str, draws: int = DRAWS, max_lag: int = MAX_LAG) -> DataFrame:
    """(keys, variable, lag, b, r) like `null_scan` of every variable, from one set of shuffles.

    Takes tables whose rows are complete. A shuffle moves the row with all its variables, so sorting and joining are done once for
    all; one aggregate then holds the sums of every variable.
    """
    whole = df.filter(reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in (*variables, y)]))
    rows = positions(whole, keys, d, "rn", "n").filter(F.col("n") >= max_lag + MIN_PAIRS)
    each = F.struct(*[F.col(f"`{v}`").cast("double").alias(f"x{i}") for i, v in enumerate(variables)])
    series = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rn", each.alias("x"), F.col(y).alias("y")))).alias("s"))
    arrays = series.select(*keys, F.transform("s", lambda e: e["x"]).alias("x"), F.transform("s", lambda e: e["y"]).alias("y"))
    lagged = _lagged(arrays, keys, max_lag)
    drawn = permuted_arrays(lagged, [*keys, "lag"], "x", draws)
    long = drawn.select(*keys, "lag", "b", F.explode(F.arrays_zip("shuffled", "y")).alias("p"))
    found = long.groupBy(*keys, "lag", "b").agg(*[pearson(F.col(f"p.shuffled.x{i}"), F.col("p.y")).alias(f"r{i}") for i in range(len(variables))])
    by = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"r{i}").alias("r")) for i, v in enumerate(variables)])
    return found.select(*keys, "lag", "b", F.explode(by).alias("v")).select(*keys, "v.variable", "lag", "b", "v.r")


def _lagged(arrays: DataFrame, keys: list[str], max_lag: int) -> DataFrame:
    """One row per series and lag with the paired parts of x and y: few small rows with much work each, in a fixed number of
    tasks, which are not merged again."""
    lagged = arrays.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(max_lag))))
    lagged = lagged.repartition(4 * arrays.sparkSession.sparkContext.defaultParallelism, *keys, "lag")
    n = F.size("x") - F.col("lag")
    return lagged.filter(n >= MIN_PAIRS).select(*keys, "lag", F.slice("x", F.lit(1), n).alias("x"), F.slice("y", F.col("lag") + 1, n).alias("y"))


def scan_all(df: DataFrame, keys: list[str], d: str, variables: list[str], y: str, draws: int = DRAWS) -> tuple[DataFrame, DataFrame]:
    """The verdicts (keys, variable, lag, windows, significant, action) and the tested lags (keys, variable, lag, r, p, pairs) of all
    variables of a table of complete rows."""
    by = [*keys, "variable"]
    long = cut(per_variable(df, keys, d, variables, y), "scan_long")
    static = static_scan(long, by, d, "x", "y")
    tested = cut(permutation_p(static, shared_null_scan(df, keys, d, variables, y, draws), by, draws), "scan_tested")
    rolling = rolling_scan(long, by, d, "x", "y", tested.filter(F.col("p") < ALPHA))
    return classify(tested, rolling, by), tested


def actions(config: DataFrame, keys: list[str]) -> dict[tuple, dict[str, dict[int, str]]]:
    """What to do with each lag, per key: one entry per variable with a verdict, as `shift_layer` takes them. `config` comes from
    `lag_config`; it has a row per key and variable, whatever the length of the series."""
    out: dict[tuple, dict[str, dict[int, str]]] = {}
    for r in config.select(*keys, "variable", "action").collect():
        out.setdefault(tuple(r[k] for k in keys), {})[r["variable"]] = {int(lag): a for lag, a in r["action"].items()}
    return out


def series_arrays(df: DataFrame, keys: list[str], d: str, x: str, y: str, max_lag: int = MAX_LAG) -> DataFrame:
    """One row per series with its x and y in date order."""
    rows = complete_pairs(df, keys, d, x, y, max_lag)
    ordered = F.array_sort(F.collect_list(F.struct("rn", F.col(x).alias("x"), F.col(y).alias("y"))))
    s = rows.groupBy(*keys).agg(ordered.alias("s"))
    return s.select(*keys, F.transform("s", lambda e: e["x"]).alias("x"), F.transform("s", lambda e: e["y"]).alias("y"))


def null_scan(
    df: DataFrame, keys: list[str], d: str, x: str, y: str, draws: int = DRAWS, max_lag: int = MAX_LAG, seen: DataFrame | None = None
) -> DataFrame:
    """(keys, lag, b, r): correlations after shuffling the lagged side, one row per draw.

    With `seen`, the (keys, lag, r) of `static_scan`, the draws are compared where they are made: (keys, lag, hits), the draws whose
    correlation is at least as large. A draw's order depends on the number of pairs only, so a task makes it once.
    """
    arrays = series_arrays(df, keys, d, x, y, max_lag)
    if seen is not None:
        lags = F.map_from_entries(F.collect_list(F.struct("lag", F.coalesce("r", F.lit(float("nan"))).alias("r"))))
        arrays = arrays.join(seen.groupBy(*keys).agg(lags.alias("seen")), keys)
        at = F.transform(F.sequence(F.lit(1), F.lit(max_lag)), lambda k: F.coalesce(F.element_at("seen", k), F.lit(float("nan"))))
    spark = df.sparkSession
    # few small rows with much work each, in a fixed number of tasks, which are not merged again
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = arrays.select(*keys, F.col("x").cast("array<double>").alias("x"), F.col("y").cast("array<double>").alias("y"), *([at.alias("seen")] if seen is not None else []))
    rows = rows.repartition(parts, *keys)
    counted = seen is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                found = shuffled_r(row["x"].flatten().to_numpy(zero_copy_only=False), row["y"].flatten().to_numpy(zero_copy_only=False), draws, max_lag, orders)
                lag = np.array(list(found), np.int32)
                r = np.array(list(found.values())).reshape(len(lag), draws)
                if counted:
                    with np.errstate(invalid="ignore"):
                        # equal but for rounding counts as equal
                        hits = (np.abs(r) >= np.abs(row["seen"].flatten().to_numpy()[lag - 1])[:, None] - 1e-12).sum(axis=1)
                    own, cols = np.zeros(len(lag), np.int64), {"lag": pa.array(lag), "hits": pa.array(hits, pa.int64())}
                else:
                    own, flat = np.zeros(r.size, np.int64), r.ravel()
                    cols = {"lag": pa.array(np.repeat(lag, draws)), "b": pa.array(np.tile(np.arange(1, draws + 1), len(lag)), pa.int64()), "r": pa.array(flat, mask=np.isnan(flat))}
                yield pa.RecordBatch.from_arrays([*[row[k].take(pa.array(own)) for k in keys], *cols.values()], names=[*keys, *cols])

    more = [("lag", T.IntegerType()), ("hits", T.LongType())] if counted else [("lag", T.IntegerType()), ("b", T.LongType()), ("r", T.DoubleType())]
    return rows.mapInArrow(run, T.StructType([*[rows.schema[k] for k in keys], *[T.StructField(c, kind) for c, kind in more]]))


def shuffled_r(x: np.ndarray, y: np.ndarray, draws: int, max_lag: int, orders: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Per lag with enough pairs the correlation of y with each shuffle of the lagged x, NaN for a constant side. `orders` keeps the
    orders of the draws by number of pairs, up to a bounded size."""
    out = {}
    for lag in range(1, min(max_lag, len(x) - MIN_PAIRS) + 1):
        m = len(x) - lag
        a, b = x[:m], y[lag:]
        if m not in orders:
            if sum(o.size for o in orders.values()) > KEPT_CELLS:
                orders.clear()
            j = np.arange(m, dtype=np.int64)
            orders[m] = np.array([np.argsort(draw_key(np.int64(k), j), kind="stable") for k in range(1, draws + 1)])
        if (a == a[0]).all() or (b == b[0]).all():
            out[lag] = np.full(draws, np.nan)
            continue
        a, b = a - a.mean(), b - b.mean()
        out[lag] = a.take(orders[m]) @ b / np.sqrt((a @ a) * (b @ b))
    return out


def permutation_p(static: DataFrame, null: DataFrame, keys: list[str], draws: int = DRAWS) -> DataFrame:
    """(keys, lag, r, p): share of all shuffles whose correlation is at least as large; one without
    a correlation is not. `null` has a row per draw, or their number as `hits`."""
    seen = static.select(*keys, "lag", F.col("r").alias("r_obs"))
    hit = F.col("hits") if "hits" in null.columns else (F.abs("r") >= F.abs("r_obs")).cast("double")
    # joined on (series, lag): one observed value against its own draws
    out = null.join(seen, [*keys, "lag"]).groupBy(*keys, "lag").agg(F.first("r_obs").alias("r"), (F.coalesce(F.sum(hit), F.lit(0.0)) / draws).alias("p"))
    return out


def rolling_scan(df: DataFrame, keys: list[str], d: str, x: str, y: str, lags: DataFrame, window: int = WINDOW, step: int = STEP) -> DataFrame:
    """(keys, lag, start, r, pairs): the same correlation inside windows of `window` rows.

    `lags` lists the (keys, lag) to look at. A window holds the pairs (i, i + lag) that lie inside
    it; the windows of a pair are an arithmetic range, so membership is an explode.
    """
    longest = window - MIN_WINDOW_PAIRS
    rows = positions(df, keys, d, "rn", "n")
    past = over_rows(
        rows, keys, d,
        [lambda c: {"past": F.collect_list(F.struct(F.col(x).alias("v"))).over(c.w.rowsBetween(-longest, -1))}],
        before=longest,
    )
    size = F.size("past")
    # lags come to the series before its rows multiply, which then stay where they are
    past = past.join(lags.groupBy(*keys).agg(F.collect_set(F.col("lag").cast("int")).alias("__lags")), keys)
    long = past.select(*keys, y, "rn", "n", "__lags", size.alias("m"), F.posexplode("past").alias("k", "p"))
    long = long.filter(F.array_contains("__lags", F.col("m") - F.col("k")))
    long = long.select(*keys, (F.col("m") - F.col("k")).alias("lag"), "rn", "n", F.col("p.v").alias("x_lag"), F.col(y).alias("y_now"))
    i = F.col("rn") - 1 - F.col("lag")
    # starts s with s <= i < s + window - lag, s % step == 0, s < n - window - lag
    first = F.greatest(F.floor((i - (window - F.col("lag"))) / step) + 1, F.lit(0))
    last = F.least(F.floor(i / step), F.floor((F.col("n") - window - F.col("lag") - 1) / step))
    starts = F.when(first <= last, F.sequence(first, last))
    member = long.filter(F.col("x_lag").isNotNull() & F.col("y_now").isNotNull()).withColumn("s", F.explode(starts))
    out = member.groupBy(*keys, "lag", (F.col("s") * step).alias("start")).agg(
        pearson("x_lag", "y_now").alias("r"), F.count(F.lit(1)).alias("pairs")
    )
    return out.filter(F.col("pairs") >= MIN_WINDOW_PAIRS)


def pearson_p(r: str | Column, n: str | Column) -> Column:
    """Two-sided p-value of a correlation of n pairs.

    The t distribution with whole degrees of freedom has a finite cosine series, folded here over
    (n - 2) / 2 terms.
    """
    r = F.col(r) if isinstance(r, str) else r
    n = F.col(n) if isinstance(n, str) else n
    dof = n - 2
    # theta = atan(t / sqrt(dof)) is asin(r)
    sin, cos2 = F.abs(r), 1 - r * r
    odd = dof % 2 == 1
    terms = F.floor((dof - F.when(odd, 1).otherwise(0)) / 2).cast("int")
    first = F.when(odd, F.sqrt(cos2)).otherwise(F.lit(1.0))
    start = F.struct(F.lit(0.0).alias("sum"), first.alias("term"))

    def add(acc: Column, k: Column) -> Column:
        k = k.cast("double")
        grow = F.when(odd, (2 * k) / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k)) * cos2
        return F.struct((acc["sum"] + acc["term"]).alias("sum"), (acc["term"] * grow).alias("term"))

    ks = F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    series = F.aggregate(ks, start, add)["sum"]
    area = F.when(odd, (F.asin(sin) + sin * series) * (2 / math.pi)).otherwise(sin * series)
    p = F.greatest(1 - area, F.lit(0.0))
    return F.when((dof >= 1) & (F.abs(r) <= 1), p)


def classify(static: DataFrame, rolling: DataFrame, keys: list[str], alpha: float = ALPHA, share: float = STABLE_SHARE) -> DataFrame:
    """Verdict per significant lag: shift_feature when most windows agree, else rolling_corr.

    `static` has (lag, r, p), `rolling` has (lag, start, r, pairs). Lags without any window are
    dropped, as their stability is unknown.
    """
    sig = F.coalesce(pearson_p("r", "pairs") < alpha, F.lit(False))
    windows = rolling.groupBy(*keys, "lag").agg(F.count(F.lit(1)).alias("windows"), F.count_if(sig).alias("significant"))
    out = static.filter(F.col("p") < alpha).join(windows, [*keys, "lag"])
    stable = F.col("significant") / F.col("windows") >= share
    return out.withColumn("action", F.when(stable, "shift_feature").otherwise("rolling_corr"))


def lag_config(classified: DataFrame, static: DataFrame, keys: list[str], alpha: float = ALPHA) -> DataFrame:
    """One row per variable: its lags by kind and the strongest significant correlation."""
    best = static.filter(F.col("p") < alpha).groupBy(*keys).agg(
        F.array_sort(F.collect_list("lag")).alias("significant_lags_weeks"), F.max(F.abs("r")).alias("best_abs_r")
    )
    at = lambda a: F.array_sort(F.collect_list(F.when(F.col("action") == a, F.col("lag"))))
    kinds = classified.groupBy(*keys).agg(
        at("shift_feature").alias("stable_lags"),
        at("rolling_corr").alias("unstable_lags"),
        F.map_from_entries(F.collect_list(F.struct("lag", "action"))).alias("action"),
    )
    return best.join(kinds, keys)
