"""Data-quality checks: each returns rows (check, subject, status, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nullsafe import is_true, pearson
from .joins import shared_dates
from .labels import LABEL_COLUMNS, forward_return
from .ordered import over_rows


def result(df: DataFrame, name: str, subject: Column, ok: Column, detail: Column, bad: str = "FAIL") -> DataFrame:
    return df.select(
        F.lit(name).alias("check"),
        subject.cast("string").alias("subject"),
        F.when(is_true(ok), "PASS").otherwise(bad).alias("status"),
        detail.cast("double").alias("detail"),
    )


def subject_of(keys: list[str]) -> Column:
    return F.concat_ws("/", *[F.col(k).cast("string") for k in keys])


def no_null(df: DataFrame, keys: list[str]) -> DataFrame:
    """No missing value in any column; detail is their number."""
    cells = [F.col(c).isNull().cast("long") for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.sum(reduce(lambda a, b: a + b, cells)).alias("nulls"))
    return result(out, "no_null", subject_of(keys), F.col("nulls") == 0, F.col("nulls"))


def split_overlap(df: DataFrame, keys: list[str], d: str) -> DataFrame:
    """No date in two splits."""
    out = shared_dates(df, keys, d, "split")
    n = F.col("train_val") + F.col("val_test") + F.col("train_test")
    return result(out, "split_overlap", subject_of(keys), n == 0, n)


def target_leak(packed: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """No label among the feature names, and windows no wider than the features there are."""
    leaked = set(features) & {*LABEL_COLUMNS}
    width = packed.groupBy(*keys).agg(F.max(F.size(F.get("dynamic", F.lit(0)))).alias("w"))
    ok = F.lit(not leaked) & (F.col("w") <= len(set(features) - leaked))
    return result(width, "target_leak", subject_of(keys), ok, F.col("w"))


def window_shapes(packed: DataFrame, keys: list[str]) -> DataFrame:
    """Windows, static vectors and targets agree in number and size."""
    inner = F.transform("dynamic", lambda v: F.size(v))
    s = packed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count("y").alias("ny"), F.count("static").alias("ns"),
        F.min(F.size("dynamic")).alias("lo"), F.max(F.size("dynamic")).alias("hi"),
        F.min(F.array_min(inner)).alias("wlo"), F.max(F.array_max(inner)).alias("whi"),
        F.min(F.size("static")).alias("slo"), F.max(F.size("static")).alias("shi"),
    )
    same = lambda a, b: F.col(a) == F.col(b)
    ok = same("n", "ny") & same("n", "ns") & same("lo", "hi") & same("wlo", "whi") & same("slo", "shi")
    return result(s, "window_shapes", subject_of(keys), ok, F.col("n"))


def scaler_range(packed: DataFrame, keys: list[str], eps: float = 1e-6) -> DataFrame:
    """Training values inside [0, 1] (detail: their range); test values outside only warn."""
    flat = F.flatten("dynamic")
    outside = F.size(F.filter(flat, lambda v: (v < 0) | (v > 1)))
    train, test = F.col("split") == "train", F.col("split") == "test"
    s = packed.groupBy(*keys).agg(
        F.min(F.when(train, F.array_min(flat))).alias("lo"),
        F.max(F.when(train, F.array_max(flat))).alias("hi"),
        F.sum(F.when(test, outside)).alias("out"),
    )
    inside = (F.col("lo") >= -eps) & (F.col("hi") <= 1 + eps)
    a = result(s, "scaler_range_train", subject_of(keys), inside, F.col("hi") - F.col("lo"))
    b = result(s, "scaler_range_test", subject_of(keys), F.col("out") == 0, F.col("out"), bad="WARN")
    return a.unionByName(b)


def base_rate(df: DataFrame, keys: list[str], label: str, lo: float = 0.10, hi: float = 0.60) -> DataFrame:
    """Share of positives of 0/1 labels in the training split; other labels pass unchecked."""
    s = df.filter(F.col("split") == "train").groupBy(*keys).agg(
        F.avg(label).alias("rate"), F.min(F.col(label).isin(0, 1).cast("int")).alias("binary")
    )
    ok = (F.col("binary") == 0) | F.col("rate").between(lo, hi)
    return result(s, "base_rate", subject_of(keys), ok, F.col("rate"))


def monotonic(df: DataFrame, keys: list[str], ingest: str, d: str) -> DataFrame:
    """Dates strictly increase in ingest order; detail is the number of steps that do not."""
    steps = over_rows(
        df.select(*keys, ingest, d), keys, ingest,
        [lambda c: {"bad": is_true(F.col(d) <= F.lag(d).over(c.w)).cast("int")}],
        before=1,
    )
    s = steps.groupBy(*keys).agg(F.sum("bad").alias("bad"))
    return result(s, "monotonic", subject_of(keys), F.col("bad") == 0, F.col("bad"))


def forward_direction(df: DataFrame, keys: list[str], d: str, price: str, stored: str, rows: int, limit: float = 0.80) -> DataFrame:
    """Stored forward returns agree with returns recomputed from the rows ahead."""
    again = over_rows(df, keys, d, [forward_return(price, rows, "again")], before=0, after=rows)
    s = again.groupBy(*keys).agg(pearson(stored, "again").alias("r"))
    return result(s, "forward_direction", subject_of(keys), F.col("r") > limit, F.col("r"))


def run_all(checks: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), checks)


def status_counts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
