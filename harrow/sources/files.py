"""File sources: CSV, JSON and partitioned prediction tables, with explicit schemas."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import to_day

# Report items, their column names, and the states kept.
MEASURES = {
    "CORN - PROGRESS, MEASURED IN PCT PLANTED": "planting_pct",
    "CORN - PROGRESS, MEASURED IN PCT EMERGED": "emerged_pct",
    "CORN - PROGRESS, MEASURED IN PCT SILKING": "silking_pct",
    "CORN - PROGRESS, MEASURED IN PCT DOUGH": "dough_pct",
    "CORN - PROGRESS, MEASURED IN PCT DENTED": "dented_pct",
    "CORN - PROGRESS, MEASURED IN PCT MATURE": "mature_pct",
    "CORN - PROGRESS, MEASURED IN PCT HARVESTED": "harvested_pct",
    "CORN - CONDITION, MEASURED IN PCT GOOD": "condition_good_pct",
    "CORN - CONDITION, MEASURED IN PCT EXCELLENT": "condition_excellent_pct",
    "CORN - CONDITION, MEASURED IN PCT POOR": "condition_poor_pct",
    "CORN - CONDITION, MEASURED IN PCT VERY POOR": "condition_very_poor_pct",
}
STATES = ["IOWA", "ILLINOIS", "INDIANA", "MINNESOTA", "NEBRASKA", "US TOTAL"]


def number(c: str | Column) -> Column:
    """Text to double, null when it is not a number; NaN and infinities are null too."""
    x = F.trim(c if isinstance(c, Column) else F.col(c)).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def by_header(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Headed CSV files with columns bound by name; every file must have the header of the first one."""
    names = [f.name for f in spark.read.csv(path, header=True).schema if f.name not in _partitions(spark, path)]
    missing = set(columns) - set(names)
    if missing:
        raise ValueError(f"columns {sorted(missing)} are not in the header of {path}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    raw = spark.read.schema(schema).csv(path, header=True, enforceSchema=False)
    return raw.withColumns({c: F.col(c).cast(kind) for c, kind in columns.items() if kind != "string"})


def _partitions(spark: SparkSession, path: str) -> set[str]:
    """Names that stand in the folders (`name=value`), not in the files."""
    return {m for f in spark.read.text(path).limit(1).select(F.col("_metadata.file_path")).collect() for m in re.findall(r"/([^/=]+)=[^/]*(?=/)", f[0])}


def read_bars_csv(spark: SparkSession, path: str, columns: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    """Daily bars from headed CSV text.

    The date column may be called `index`; rows without a date (a repeated header) are dropped;
    prices which are not numbers become null.
    """
    raw = by_header(spark, path, {c: "string" for c in columns})
    if "index" in raw.columns and "Date" not in raw.columns:
        raw = raw.withColumnRenamed("index", "Date")
    prices = [c for c in ("Open", "High", "Low", "Close", "Volume") if c in raw.columns]
    out = raw.select(
        *extra, to_day("Date").alias("d"), *[number(c).alias(c.lower()) for c in prices]
    )
    return out.filter(F.col("d").isNotNull())


def read_series_dir(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """All CSV files of a directory; series and group come from the file (or folder) name.

    `clean_despiked_coffee_North.csv` is series `coffee_North` of group `coffee`.
    """
    raw = by_header(spark, path, columns)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+?)(?:\.csv)?(?:/part-[^/]*)?$", 1)
    series = F.regexp_replace(name, "^(?:clean_)?(?:despiked_)?", "")
    return raw.select(*columns, series.alias("series")).withColumn("grp", F.substring_index("series", "_", 1))


STATISTICS = "Results struct<series: array<struct<data: array<struct<year: string, period: string, value: string>>>>>"


def flatten_statistics(df: DataFrame, payload: str) -> DataFrame:
    """Nested monthly statistics to (d, value); annual rows and non-numbers are dropped."""
    doc = F.from_json(payload, STATISTICS)
    item = (
        df.select(doc.alias("doc"))
        .select(F.explode("doc.Results.series").alias("s"))
        .select(F.explode("s.data").alias("i"))
        .filter(F.col("i.period") != "M13")
    )
    month = F.regexp_replace("i.period", "M", "").try_cast("int")
    day = F.try_make_date(F.col("i.year").try_cast("int"), month, F.lit(1)) if hasattr(F, "try_make_date") else (
        F.expr("try_to_date(concat(i.year, '-', lpad(regexp_replace(i.period, 'M', ''), 2, '0'), '-01'), 'yyyy-MM-dd')")
    )
    return item.select(day.alias("d"), number("i.value").alias("value")).filter(F.col("value").isNotNull())


def measure_name(c: str | Column) -> Column:
    """Column name of a report item, null for items that are not wanted."""
    c = F.upper(F.trim(c if isinstance(c, Column) else F.col(c)))
    pairs = [F.lit(v) for kv in MEASURES.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def flatten_report(df: DataFrame, payload: str) -> DataFrame:
    """JSON report rows to (week_ending, state, measure, v)."""
    row = F.from_json(payload, "week_ending_date string, state_name string, short_desc string, Value string")
    out = df.select(row.alias("r")).select(
        to_day("r.week_ending_date").alias("week_ending"),
        F.col("r.state_name").alias("state"),
        measure_name("r.short_desc").alias("measure"),
        number(F.regexp_replace("r.Value", ",", "")).alias("v"),
    )
    return out.filter(F.col("measure").isNotNull() & F.col("week_ending").isNotNull())


def parse_export(df: DataFrame) -> DataFrame:
    """Report export with free-form header names to (week_ending, state, measure, v).

    Values withheld as `(D)` become null; rows of other states or items are dropped.
    """
    named = df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])
    missing = {"week_ending", "geo_level", "state", "data_item", "value"} - set(named.columns)
    if missing:
        raise ValueError(f"export lacks columns {sorted(missing)}")
    out = named.select(
        to_day("week_ending").alias("week_ending"),
        F.upper(F.trim("state")).alias("state"),
        measure_name("data_item").alias("measure"),
        number(F.regexp_replace("value", "[,()D ]", "")).alias("v"),
    )
    keep = F.col("week_ending").isNotNull() & F.col("state").isin(*STATES) & F.col("measure").isNotNull()
    return out.filter(keep)


def numeric_rows(df: DataFrame, c: str) -> DataFrame:
    """Rows whose value is a number, as double."""
    return df.withColumn(c, number(c)).filter(F.col(c).isNotNull())


def containing(df: DataFrame, needles: dict[str, str]) -> DataFrame:
    """Rows whose columns contain the given texts, whatever the case."""
    for c, text in needles.items():
        df = df.filter(F.lower(c).contains(text.lower()))
    return df


def read_predictions(spark: SparkSession, path: str, model=None, split: str | None = None) -> DataFrame:
    """Predictions partitioned by model and split; filters prune folders, an absent model has no rows."""
    out = spark.read.parquet(path)
    if model is not None:
        out = out.filter(F.col("model") == model)
    return out if split is None else out.filter(F.col("split") == split)


RESULTS = (
    "tag string, model string, best_threshold double, "
    "splits map<string, struct<auc_roc: double, pr_auc: double, f1: double, n_samples: long>>"
)


def read_results(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split's metrics out of nested result documents, 0 where a metric is absent."""
    doc = spark.read.schema(RESULTS).json(path)
    s = F.try_element_at("splits", F.lit(split))
    zero = lambda f, z: F.coalesce(s[f], F.lit(z))
    return doc.select(
        "tag", "model",
        F.coalesce("best_threshold", F.lit(0.5)).alias("threshold"),
        zero("auc_roc", 0.0).alias("auc"), zero("pr_auc", 0.0).alias("pr_auc"),
        zero("f1", 0.0).alias("f1"), zero("n_samples", 0).alias("n"),
    )
