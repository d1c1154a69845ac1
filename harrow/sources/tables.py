"""Market-shaped views over the star-schema tables, as DataFrames.

Each view is one aggregation over a whole table, so work grows with the table and the hot part
(the scan) is combined map-side before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import in_months, spine_of
from ..functions.nullsafe import ratio
from ..operators.ordered import over_rows, positions
from ..operators.splits import chrono_split

# Months of the crop stages.
CROP_MONTHS = {
    "coffee": {"is_flowering": [9, 10, 11], "is_harvest": [5, 6, 7, 8]},
    "corn": {"is_planting": [4, 5], "is_pollination": [7], "is_harvest": [9, 10, 11]},
}
PRICE_UNIT = 1e4
THETA = 0.025
#: Line items behind a partition of the daily bars, and the least number of them that is worth a task.
LAYOUT_ROWS = 100_000
LEAST_ROWS = 10_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def layout_parts(spark: SparkSession, rows: int) -> int:
    """Partitions for series made of `rows` rows: as many as there are cores, more as the table grows."""
    return max(1, rows // LAYOUT_ROWS, min(spark.sparkContext.defaultParallelism, rows // LEAST_ROWS))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars, one series per supplier: (symbol, d, open, high, low, close, volume).

    Laid out by symbol in a number of partitions that grows with the table. What follows keeps this layout, and rows multiply (models,
    classes, lags) after it, so the size of a task is set here, not by the bytes of the shuffle. Line items are dealt out by symbol
    once and combined there. Where a symbol has more of them than a partition should hold, they are combined before they are moved, and then moved again.
    """
    table = read(spark, sf_dir, "lineitem")
    rows, hottest = table.groupBy("l_suppkey").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    parts = layout_parts(spark, rows)
    raw = table.select(
        F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("d"), "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_quantity")
    if hottest <= LAYOUT_ROWS:
        return daily_bars(raw.repartition(parts, "symbol"))
    return daily_bars(raw).repartition(parts, "symbol")


def daily_bars(raw: DataFrame) -> DataFrame:
    price = F.col("l_extendedprice") / PRICE_UNIT
    at = F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    lines = raw.select(
        "symbol", "d",
        price.alias("p"),
        (price * (1 - F.col("l_discount"))).alias("p_low"),
        (price * (1 + F.col("l_tax"))).alias("p_high"),
        at.alias("at"),
        "l_quantity",
    )
    return lines.groupBy("symbol", "d").agg(
        F.min_by("p", "at").alias("open"),
        F.max("p_high").alias("high"),
        F.min("p_low").alias("low"),
        F.max_by("p", "at").alias("close"),
        F.sum("l_quantity").alias("volume"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor readings, one series per event type, ordered by id: (sensor, seq, x, v, k).

    A handful of series hold all rows, whatever the scale. x is missing where k < 15.
    """
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_type").alias("sensor"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("v"),
        k.alias("k"),
    ).withColumn("x", F.when(F.col("k") >= 15, F.col("v")))


def fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One currency / index series: (d, close, high, low)."""
    p = F.col("l_extendedprice")
    li = read(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("d"))
    return li.agg(
        (F.avg(p) / PRICE_UNIT).alias("close"),
        (F.max(p) / PRICE_UNIT).alias("high"),
        (F.min(p) / PRICE_UNIT).alias("low"),
    )


def macro_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly price index: (d, v), d the first of the month."""
    li = read(spark, sf_dir, "lineitem").groupBy(F.trunc(F.to_date("l_shipdate"), "MM").alias("d"))
    return li.agg((F.avg("l_extendedprice") / PRICE_UNIT).alias("v"))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily station table per region; one hour of events plays one day.

    Columns: region, d, temp_max, temp_min, precip, et0, vpd_max.
    """
    hour_no = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")
    day = F.date_add(F.lit("2000-01-01").cast("date"), hour_no)
    v = F.col("value")
    return (
        read(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("region"), day.alias("d"))
        .agg(
            F.max(v).alias("temp_max"),
            F.min(v).alias("temp_min"),
            F.sum(F.when(v < 20, v).otherwise(0.0)).alias("precip"),
            F.avg(v).alias("et0"),
            (F.max(v) - F.min(v)).alias("vpd_max"),
        )
    )


def calendar(spark: SparkSession, sf_dir: str, crop: str) -> DataFrame:
    """Daily 0/1 stage flags of a crop over the days the line items span."""
    days = spine_of(fx(spark, sf_dir).select("d"), [], "d")
    return days.select("d", *[in_months("d", m).alias(name) for name, m in CROP_MONTHS[crop].items()])


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly report values in long form: (week_ending, state, measure, v)."""
    state = (
        F.when(F.col("l_returnflag") == "A", "US TOTAL")
        .when(F.col("l_returnflag") == "N", "IOWA")
        .otherwise("ILLINOIS")
    )
    week = F.date_add(F.trunc(F.to_date("l_shipdate"), "WEEK"), 5)
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy(week.alias("week_ending"), state.alias("state"), F.col("l_linenumber").alias("measure"))
        .agg(F.min("l_quantity").alias("v"))
    )


def returns(spark: SparkSession, sf_dir: str, horizon: int = 7, keep: list[str] = ()) -> DataFrame:
    """Realised forward returns: (tag, d, rn, r), rows without a return dropped; and columns of the bars."""
    b = bars(spark, sf_dir).select(F.col("symbol").alias("tag"), "d", "close", *[c for c in keep if c != "close"])
    b = positions(b, ["tag"], "d")
    b = over_rows(
        b, ["tag"], "d",
        [lambda c: {"r": ratio(F.lead("close", horizon).over(c.w), "close") - 1}],
        before=0, after=horizon,
    )
    return b.filter(F.col("r").isNotNull()).select("tag", "d", "rn", "r", *keep)


def returns_split(spark: SparkSession, sf_dir: str, keep: list[str] = ()) -> DataFrame:
    """Returns of series and days with their split: (tag, d, rn, r, split). The split goes by their own positions; rows keep the layout of the
    bars, and rn is that of the bars."""
    rows = returns(spark, sf_dir, keep=keep).withColumnRenamed("rn", "__rn")
    out = chrono_split(rows, ["tag"], "d", 7).filter("tag is not null and d is not null")
    return out.select("tag", "d", F.col("__rn").alias("rn"), "r", *keep, "split")


def predictions(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """Long prediction table of four models per tag.

    Columns: tag, model, d, rn, r, y_true, p_up, p_down, p_flat, p, y_hat, cls; and what `base`, by default all returns, has besides.
    """
    base = returns(spark, sf_dir) if base is None else base
    more = [c for c in base.columns if c not in ("tag", "d", "rn", "r")]
    m = base.withColumn("model", F.explode(F.array(*[F.lit(i) for i in range(1, 5)])))
    rn, model, tag = F.col("rn"), F.col("model"), F.col("tag")
    p = ((rn * 7919 * model + tag * 31) % 1000).cast("double") / 1000.0
    down = (((rn * 104729 * model + tag * 17) % 997) + 1).cast("double")
    flat = (((rn * 1299709 * model + tag * 7) % 991) + 1).cast("double")
    up = (((rn * 15485863 * model + tag * 3) % 983) + 1).cast("double")
    total = F.col("_d") + F.col("_f") + F.col("_u")
    out = m.withColumns({"p": p, "_d": down, "_f": flat, "_u": up}).withColumns(
        {
            "y_true": (F.col("r") > THETA).cast("int"),
            "p_down": F.col("_d") / total,
            "p_flat": F.col("_f") / total,
            "p_up": F.col("_u") / total,
            "y_hat": (F.col("p") - 0.5) / 5.0,
            "cls": F.when(F.col("r") > THETA, 2).when(F.col("r") < -THETA, 0).otherwise(1),
        }
    )
    return out.select(
        "tag", "model", "d", "rn", "r", "y_true", "p", "p_down", "p_flat", "p_up", "y_hat", "cls", *more
    )
