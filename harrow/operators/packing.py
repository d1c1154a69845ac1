"""Sequence windows as array columns.

`pack_windows` packs named columns; `pack_table` finds them in the schema of an integrated table, scales them from its training
rows and packs all widths from one window per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import feature_columns
from .labels import SOFT_CLASSES
from .ordered import over_rows
from .splits import minmax_scale

# Widths of daily and weekly windows, and columns that are no inputs of a sequence model.
WIDTHS = {False: [14, 30, 45], True: [4, 8, 12]}
PROTECTED = ["close", "currency_adjusted_close"]


def pack_windows(
    df: DataFrame,
    keys: list[str],
    d: str,
    dynamic: list[str],
    static: list[str],
    target: Column,
    rows: int,
    keep: list[str] = (),
) -> DataFrame:
    """One row per full window of `rows` rows inside each key (keys include the split).

    dynamic: array of rows, each an array of features; static and target belong to the last row.
    """
    vectors = df.select(
        *keys, d, *keep,
        F.array(*dynamic).alias("__v"),
        (F.array(*static) if static else F.array().cast("array<double>")).alias("static"),
        target.alias("y"),
    )
    out = over_rows(
        vectors, keys, d,
        [lambda c: {"dynamic": F.collect_list("__v").over(c.back(rows))}],
        before=rows - 1,
    )
    full = out.filter(F.size("dynamic") == rows)
    return full.select(*keys, d, *keep, F.lit(rows).alias("win"), "dynamic", "static", "y")


def metadata_rows(df: DataFrame, keys: list[str], d: str, rows: int) -> DataFrame:
    """Rows which are the last of a full window."""
    from .ordered import positions

    return positions(df, keys, d, "__rn").filter(F.col("__rn") >= rows).drop("__rn")


def tensor_columns(df: DataFrame, keys: list[str], static: list[str] = ()) -> tuple[list[str], list[str]]:
    """(dynamic, static): the numeric columns that are neither keys, labels nor protected; static ones are named, those that exist."""
    features = feature_columns(df, [*keys, *PROTECTED])
    known = [c for c in static if c in features]
    return [c for c in features if c not in known], known


def pack_table(df: DataFrame, keys: list[str], d: str, widths: list[int], static: list[str] = (), ignore: list[str] = ()) -> DataFrame:
    """All windows of a table with `split`: (keys, split, d, win, dynamic, static, y, y_classes).

    Inputs come from the schema and are scaled by the training range of their series. Windows do not cross splits. A row
    gets the longest window once; narrower windows are its ends, cut off where they are used. y is the binary label, y_classes the soft
    distribution over three classes; both, and static, belong to the last row. Missing inputs are 0 after scaling.
    """
    dynamic, fixed = tensor_columns(df.drop(*ignore), keys, static)
    scaled = minmax_scale(df, keys, [*dynamic, *fixed])
    vector = lambda cols: F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]) if cols else F.array().cast("array<double>")
    rows = scaled.select(*keys, "split", d, vector(dynamic).alias("__v"), vector(fixed).alias("static"), F.col("target_binary").alias("y"), F.array(*SOFT_CLASSES).alias("y_classes"))
    longest = max(widths)
    out = over_rows(rows, [*keys, "split"], d, [lambda c: {"longest": F.collect_list("__v").over(c.back(longest))}], before=longest - 1)
    wide = out.withColumn("win", F.explode(F.filter(F.array(*map(F.lit, widths)), lambda w: w <= F.size("longest"))))
    return wide.select(*keys, "split", d, "win", F.slice("longest", F.size("longest") - F.col("win") + 1, F.col("win")).alias("dynamic"), "static", "y", "y_classes")
