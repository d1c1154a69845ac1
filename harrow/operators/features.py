"""Feature-table helpers: flags, consistency, column selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nullsafe import finite, flag
from ..sources.sinks import cut
from .labels import LABEL_COLUMNS

NOT_FEATURES = {"d", *LABEL_COLUMNS}


def day_flags(df: DataFrame, temp: str = "temp_max", rain: str = "precip") -> DataFrame:
    """Hot, cold and dry day flags; unknown counts as 0."""
    return df.withColumns(
        {
            "hot_day": flag(F.col(temp) > 30),
            "cold_day": flag(F.col(temp) < 10),
            "dry_day": flag(F.col(rain) == 0),
        }
    )


def ohlc_consistent(df: DataFrame) -> DataFrame:
    """The high is at least, the low at most the close; unknown if either is unknown."""
    known = lambda a: F.col(a).isNotNull() & F.col("close").isNotNull()
    return df.withColumns(
        {
            "high": F.when(known("high"), F.greatest("high", "close")),
            "low": F.when(known("low"), F.least("low", "close")),
        }
    )


def drop_all_null_columns(df: DataFrame, at_once: int | None = None) -> DataFrame:
    """Drop columns without any value; one pass which returns a single row of counts.

    `at_once`, for stored tables: so many columns a pass, each of which reads its own columns only. The code for all
    columns of a wide table is too long to be compiled by the JVM.
    """
    step, seen = at_once or max(1, len(df.columns)), {}
    for i in range(0, len(df.columns), step):
        seen |= df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in df.columns[i:i + step]]).first().asDict()
    return df.select(*[c for c in df.columns if seen[c]])


def whole(fields: list[T.StructField]) -> Column:
    """Whether no column is missing or NaN; a row is left at its first missing value."""
    out = F.lit(True)
    for f in fields:
        out = out & F.col(f"`{f.name}`").isNotNull()
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out = out & ~F.isnan(f"`{f.name}`")
    return out


def complete(df: DataFrame) -> DataFrame:
    """Rows without a missing value or NaN, as `na.drop` gives them; but a row is left at its first missing value, and
    Parquet skips pages without values."""
    return df.filter(whole(df.schema.fields))


def columns_with_values(df: DataFrame) -> set[str]:
    """Columns with a value in any row."""
    seen = df.agg(*[F.max(F.col(f"`{c}`").isNotNull()).alias(c) for c in df.columns]).first().asDict()
    return {c for c in df.columns if seen[c]}


def complete_but_empty(df: DataFrame, known: set[str], name: str, every: DataFrame | None = None) -> DataFrame:
    """`complete(drop_all_null_columns(df))`, stored. `known` names columns that have a value somewhere: rows that miss one of them are
    dropped whatever the other columns hold, so they are not written. The other columns are looked for in a pass of their own over all rows, those of
    `every`, if `df` has lost some."""
    if not known:
        # looked at twice: once for empty columns, once for the rows
        return complete(drop_all_null_columns(cut(df, name), 12))
    rest = [c for c in df.columns if c not in known]
    seen = columns_with_values((df if every is None else every).select(*rest)) if rest else set()
    stored = cut(df.filter(whole([f for f in df.schema if f.name in known])), name)
    kept = stored.select(*[c for c in df.columns if c in known or c in seen])
    return kept.filter(whole([f for f in kept.schema if f.name not in known]))


def feature_columns(df: DataFrame, drop: list[str] = ()) -> list[str]:
    """Numeric columns which are neither labels nor named in drop."""
    out = {*NOT_FEATURES, *drop}
    return [f.name for f in df.schema if f.name not in out and isinstance(f.dataType, T.NumericType)]


def sanitize(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """Feature matrix in the given order: absent columns, nulls and infinities become 0."""
    def clean(c: str):
        if c not in df.columns:
            return F.lit(0.0).alias(c)
        return F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)).alias(c)

    return df.select(*keep, *[clean(c) for c in features])


def drop_by_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])
