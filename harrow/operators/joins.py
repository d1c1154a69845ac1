"""Joins on dates and positions. Equi joins only: Spark picks broadcast or merge by measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import forward_fill
from .ordered import Run, positions, running


def prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    """Namespace all columns except the join keys."""
    return df.select(*keep, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keep])


def left_on(df: DataFrame, sources: list[DataFrame], on: list[str]) -> DataFrame:
    for s in sources:
        df = df.join(s, on, "left")
    return df


def exact_then_carry(df, source, keys: list[str], d: str) -> DataFrame:
    """Left join on the exact date, then carry every column forward.

    A source date that is not a date of the series loses its value.
    """
    out = df.join(source, [c for c in (*keys, d) if c in source.columns], "left")
    return forward_fill(out, keys, d, [c for c in out.columns if c not in (*keys, d)])


def asof_backward(df, source, keys: list[str], d: str, cols: list[str]) -> DataFrame:
    """Latest source value at or before each row's date; the source is keyed like the series.

    Both sides are stacked and the value carried forward, so there is no range join.
    """
    left = df.withColumn("__src", F.lit(False))
    right = source.select(*keys, d, *cols).withColumn("__src", F.lit(True))
    both = left.unionByName(right, allowMissingColumns=True)
    # source rows sort before rows of the same date
    both = both.withColumn("__at", F.unix_date(d).cast("long") * 2 + F.when(F.col("__src"), 0).otherwise(1))
    out = running(both, keys, "__at", {c: Run("last", F.col(c)) for c in cols})
    return out.filter(~F.col("__src")).drop("__src", "__at")


def asof_backward_shared(df, source, d: str, cols: list[str]) -> DataFrame:
    """As-of join of one dated series shared by all keys.

    The source is laid out on every day up to the last row of `df` (calendar-bounded) and joined
    on the exact date.
    """
    span = source.select(F.col(d).alias("__s"), F.col(d).alias("__any")).unionByName(
        df.select(F.lit(None).cast("date").alias("__s"), F.col(d).alias("__any"))
    ).agg(F.min("__s").alias("lo"), F.max("__any").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias(d))
    daily = days.join(source.select(d, *cols), [d], "left").withColumn("__one", F.lit(1))
    daily = forward_fill(daily, ["__one"], d, cols).drop("__one")
    return df.join(daily, [d], "left")


def models_wide(df: DataFrame, keys: list[str], model: str, names: list, value: str, anchor: list[str]) -> DataFrame:
    """Inner join of all models' predictions per key, as one grouped pivot instead of a join chain.

    The anchor columns come from the first model; rows which lack any model are dropped.
    """
    if len(names) < 2:
        raise ValueError("at least two models are needed")
    at = lambda m: F.col(model) == m
    cells = [F.max(F.when(at(m), F.col(value))).alias(f"m{m}") for m in names]
    first = [F.max(F.when(at(names[0]), F.col(a))).alias(a) for a in anchor]
    present = F.count_distinct(F.when(F.col(model).isin(*names), F.col(model))).alias("__n")
    out = df.groupBy(*keys).agg(*cells, *first, present)
    return out.filter(F.col("__n") == len(names)).drop("__n")


def tail_position(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str) -> DataFrame:
    """Align two undated sides by position from the end; the longer side loses its head."""

    def from_end(df: DataFrame, order: str) -> DataFrame:
        p = positions(df, keys, order, "__rn", "__n")
        return p.withColumn("__end", F.col("__n") - F.col("__rn")).drop("__rn", "__n")

    a = from_end(left, left_order)
    b = from_end(right, right_order)
    return a.join(b, [*keys, "__end"]).drop("__end")


def align_hurdle(test: DataFrame, up: DataFrame, down: DataFrame | None, single: DataFrame | None, on: list[str]) -> DataFrame:
    """Test rows with both leg probabilities and, where it exists, the single regression.

    Without a down model its probability falls back to max(1 - p_up, 0).
    """
    out = test.join(up, on)
    fallback = F.greatest(1 - F.col("p_up"), F.lit(0.0))
    if down is None:
        out = out.withColumn("p_down", fallback)
    else:
        out = out.join(down, on).withColumn("p_down", F.coalesce("p_down", fallback))
    return out if single is None else out.join(single, on, "left")


def align_counts(test: DataFrame, up: DataFrame, down: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """Rows per key before and after each alignment step, with the share dropped by the last."""
    marked = (
        test.select(*on)
        .join(up.select(*on).withColumn("__u", F.lit(1)), on, "left")
        .join(down.select(*on).withColumn("__d", F.lit(1)), on, "left")
    )
    u, d = F.col("__u").isNotNull(), F.col("__d").isNotNull()
    n = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_test"),
        F.count_if(u).alias("n_up"),
        F.count_if(u & d).alias("n_aligned"),
    )
    lost = F.try_divide((F.col("n_up") - F.col("n_aligned")).cast("double"), F.greatest("n_up", F.lit(1)))
    return n.withColumn("dropped", lost)


def previous_year(df: DataFrame, keys: list[str], year: str, value: str, out: str) -> DataFrame:
    prev = df.select(*keys, (F.col(year) + 1).alias(year), F.col(value).alias(out))
    return df.join(prev, [*keys, year], "left")


def cross_grid(df: DataFrame, name: str, values: list) -> DataFrame:
    """One copy of each row per grid value; the grid is a short literal, nothing is joined."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def shared_dates(df: DataFrame, keys: list[str], d: str, split: str) -> DataFrame:
    """Number of dates shared between splits, per key."""
    has = lambda s: F.max(F.when(F.col(split) == s, 1).otherwise(0))
    per_day = df.groupBy(*keys, d).agg(*[has(s).alias(s) for s in ("train", "val", "test")])
    pair = lambda a, b: F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}")
    return per_day.groupBy(*keys).agg(pair("train", "val"), pair("val", "test"), pair("train", "test"))
