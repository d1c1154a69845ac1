"""Splits and inputs of series stay in the layout of the bars."""

import pytest
from test_integrate import lines

from pyspark.sql import functions as F

from harrow.catalog import evaluation, labels
from harrow.operators import splits
from harrow.sources import tables as t


@pytest.fixture
def sf(spark, tmp_path):
    lines(spark, tmp_path)
    return str(tmp_path)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange")


def test_predictions_get_the_split_of_their_day(spark, sf):
    """As by a join of predictions and splits, without missing keys; line items are moved once."""
    got = evaluation.with_split(spark, sf)
    s = splits.chrono_split(t.returns(spark, sf).select("tag", "d"), ["tag"], "d", 7).select("tag", "d", "split")
    want = t.predictions(spark, sf).join(s, ["tag", "d"])
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 400
    assert exchanges(got) == 1


def test_inputs_get_the_split_of_their_day(spark, sf):
    got = labels.feature_split(spark, sf)
    s = splits.chrono_split(t.returns(spark, sf).select("tag", "d", "r"), ["tag"], "d", 7).select(F.col("tag").alias("symbol"), "d", "split", "r")
    want = t.bars(spark, sf).select("symbol", "d", "close", "volume", F.lit(1.0).alias("const")).join(s, ["symbol", "d"])
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 100
    assert exchanges(got) == 1
