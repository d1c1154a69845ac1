"""The integrated table: what is written on the way to its complete rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from harrow.operators import features
from harrow.plans import integrate as I
from harrow.sources import tables as t


def lines(spark, path):
    """Line items of a few symbols with days of several items, and missing keys."""
    i = F.col("id")
    spark.range(3000).select(
        F.when(i % 50 != 0, i % 4).alias("l_suppkey"), F.expr("timestamp'2000-01-01' + make_interval(0, 0, 0, cast(id % 90 as int))").alias("l_shipdate"), i.alias("l_orderkey"),
        (i % 7).cast("int").alias("l_linenumber"), (F.xxhash64("id") % 1000 / 10).alias("l_extendedprice"), (i % 11 / 100).alias("l_discount"), (i % 9 / 100).alias("l_tax"),
        F.when(i % 13 != 0, (i % 50).cast("double")).alias("l_quantity")).write.parquet(f"{path}/lineitem.parquet")


def test_bars_are_the_same_whatever_moves_first(spark, tmp_path, monkeypatch):
    lines(spark, tmp_path)
    direct = t.bars(spark, str(tmp_path))
    monkeypatch.setattr(t, "LAYOUT_ROWS", 500)  # a symbol has 750
    combined = t.bars(spark, str(tmp_path))
    assert sorted(map(str, direct.collect())) == sorted(map(str, combined.collect())) and direct.count() > 150
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange")
    assert exchanges(direct) == 1 and exchanges(combined) == 2


@pytest.mark.parametrize("known", [set(), {"a"}, {"a", "b"}])
def test_rows_that_miss_a_known_column_are_not_written(spark, monkeypatch, known):
    """The same rows as of the table written whole; `late` has values in rows only that are dropped, `empty` nowhere."""
    df = spark.range(40).select(
        "id", F.when(F.col("id") > 5, 1.0).alias("a"), F.when(F.col("id") % 2 == 0, F.col("id").cast("double")).alias("b"), F.when(F.col("id") == 30, float("nan")).otherwise(0.0).alias("c"),
        F.lit(None).cast("double").alias("empty"))
    for frame in (df, df.withColumn("late", F.when(F.col("id") < 3, 1.0))):
        written, cut = [], features.cut
        monkeypatch.setattr(features, "cut", lambda d, n: written.append(cut(d, n)) or written[-1])
        got = features.complete_but_empty(frame, known, "rows")
        monkeypatch.setattr(features, "cut", cut)
        want = features.complete(features.drop_all_null_columns(frame))
        assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
        assert written[0].count() == {0: 40, 1: 34, 2: 17}[len(known)]


def test_first_series_change_what_is_computed_and_not_the_rows(spark):
    """A source that starts late, an early column that one series has only, series without complete rows, and a gap."""
    day = lambda n: F.date_add(F.lit(datetime.date(2000, 1, 1)), n)
    i, s = F.col("i"), F.col("symbol")
    grid = spark.range(3).select(F.col("id").alias("symbol")).crossJoin(spark.range(160).select(F.col("id").cast("int").alias("i")))
    price = 10 + F.pmod(F.xxhash64("symbol", "i"), F.lit(1000)) / 100
    market = grid.filter((s != 2) | (i < 70)).select("symbol", day(F.col("i")).alias("d"), price.alias("close"), (price + 1).alias("high"), (price - 1).alias("low"), (i % 40 + 1).cast("double").alias("volume"),
                                                     F.when(s == 1, 1.0).alias("odd"), F.lit(None).cast("double").alias("nothing"))
    usd = spark.range(80, 150).select(day(F.col("id").cast("int")).alias("d"), (3 + F.col("id") % 5).cast("double").alias("close"))
    for table in (market.drop("odd"), market):
        run = lambda first: I.integrate(table, ["symbol"], {"usd_": usd}, first=first)
        want = run(None)
        for first in (s == 1, s == 2):
            got = run(first)
            assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert want.count() > 40 and "nothing" not in want.columns
