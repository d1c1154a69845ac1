"""Calendar arithmetic on DATE columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .nullsafe import col


def closing_monday(d: str | Column) -> Column:
    """Label of the (Mon, Mon] week a date falls in: the Monday that closes it."""
    return F.next_day(F.date_sub(col(d), 1), "MON")


def is_weekend(d: str | Column) -> Column:
    return F.weekday(col(d)).isin(5, 6)


def release_date(month_start: str | Column, months: int = 1, days: int = 12) -> Column:
    """Date on which a monthly figure becomes public."""
    return F.date_add(F.add_months(col(month_start), months), days)


def to_day(c: str | Column) -> Column:
    """Text to the DATE of its instant in UTC, null when it is not a date.

    Text without an offset is taken as UTC. The result does not depend on the session time zone.
    """
    text = F.trim(col(c))
    offset = (F.length(text) > 10) & text.rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$")
    zoned = F.when(offset, text).when(F.length(text) > 10, F.concat(text, F.lit("Z"))).otherwise(
        F.concat(text, F.lit(" 00:00:00Z"))
    )
    days = F.floor(F.unix_seconds(F.try_to_timestamp(zoned)) / 86400)
    return F.date_from_unix_date(days.cast("int"))


def in_months(d: str | Column, months: list[int]) -> Column:
    return F.month(col(d)).isin(*months).cast("int")


def date_spine(spark: SparkSession, first: str, last: str, name: str = "d") -> DataFrame:
    """Every day from first to last."""
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(days).alias(name))


def spine_of(df: DataFrame, keys: list[str], d: str, step_days: int = 1) -> DataFrame:
    """Every step between the first and last date of each series.

    Only min and max per series are aggregated; the rows come from exploding a sequence.
    """
    ends = df.groupBy(*keys).agg(F.min(d).alias("_lo"), F.max(d).alias("_hi"))
    days = F.sequence("_lo", "_hi", F.expr(f"interval {step_days} day"))
    return ends.select(*keys, F.explode(days).alias(d))
