"""Edge cases and invariants on small hand-made frames."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from harrow.functions import rolling as R
from harrow.functions.calendar import closing_monday, to_day
from harrow.functions.scalars import argmax, bucket_of
from harrow.operators import backtest as B
from harrow.operators import clean, labels, lagscan, metrics, resample, splits
from harrow.operators.ordered import over_rows
from harrow.plans import market, reports, weather
from harrow.sources import files


def daily(spark, **cols):
    n = len(next(iter(cols.values())))
    num = lambda x: None if x is None else float(x)
    rows = [(1, dt.date(2020, 1, 1) + dt.timedelta(i), *(num(c[i]) for c in cols.values())) for i in range(n)]
    return spark.createDataFrame(rows, "s int, d date, " + ", ".join(f"{c} double" for c in cols))


def column(df, c):
    return [r[c] for r in df.orderBy("d").collect()]


def test_rsi_without_losses(spark):
    df = daily(spark, p=[float(i) for i in range(20)])
    for mode, want in (("null", None), ("limit", 100.0)):
        out = over_rows(df, ["s"], "d", R.rsi_layers("r", "p", 14, mode), 15)
        assert column(out, "r")[-1] == want
        assert column(out, "r")[12] is None
    flat = over_rows(daily(spark, p=[5.0] * 20), ["s"], "d", R.rsi_layers("r", "p", 14, "limit"), 15)
    assert column(flat, "r")[-1] is None


def test_correlation_with_constant_side_is_unknown(spark):
    df = daily(spark, x=[1.0] * 12, y=[float(i) for i in range(12)])
    out = over_rows(df, ["s"], "d", [lambda c: {"r": R.corr(c, "x", "y", 10)}], 10)
    assert set(column(out, "r")) == {None}


def test_isolated_spike_goes_long_event_stays(spark):
    base = [10.0, 11.0, 10.5, 11.5] * 12
    isolated, event = list(base), list(base)
    isolated[20] = 500.0
    event[20:29] = [500.0 + 40 * i * i for i in range(9)]
    out = clean.drop_isolated_spikes(daily(spark, a=isolated, b=event), ["s"], "d", ["a", "b"])
    assert column(out, "a")[20] is None
    s = pd.Series(event)
    q1, q3 = (s.rolling(15, min_periods=1).quantile(q) for q in (0.25, 0.75))
    odd = (s < q1 - 3 * (q3 - q1)) | (s > q3 + 3 * (q3 - q1))
    blocks = (~odd).cumsum()
    drop = odd & (odd.groupby(blocks).transform("sum") < 7)
    assert [v is None for v in column(out, "b")] == drop.tolist()


def test_stuck_sensor(spark):
    v = [float((i * 7) % 5) for i in range(12)] + [3.0] * 10 + [float((i * 3) % 5) for i in range(8)]
    out = column(clean.drop_dead_sensor(daily(spark, a=v), ["s"], "d", ["a"]), "a")
    s = pd.Series(v)
    dead = (s.rolling(5, min_periods=1).std().fillna(0) < 1e-4).astype(int)
    assert [x is None for x in out] == (dead.rolling(4, min_periods=1).sum() >= 4).tolist()


def test_weeks_close_on_monday_and_empty_weeks_appear(spark):
    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2024, 1, 8), dt.date(2024, 1, 23)]
    df = spark.createDataFrame([(1, d, float(i)) for i, d in enumerate(days)], "s int, d date, v double")
    assert [r[0] for r in df.select(closing_monday("d")).collect()] == [days[0], days[2], days[2], dt.date(2024, 1, 29)]
    out = resample.to_weeks(df.withColumn("w", F.col("v")), ["s"], "d", {"v": "sum", "w": "last"}, every_week=True)
    rows = {r["d"]: (r["v"], r["w"]) for r in out.collect()}
    assert rows[dt.date(2024, 1, 15)] == (0.0, None) and rows[dt.date(2024, 1, 8)] == (3.0, 2.0)


def test_text_dates(spark):
    text = ["2024-03-01", "2024-03-01 00:00:00+00:00", "2024-03-01T22:00:00-05:00", "Ticker", None]
    df = spark.createDataFrame([(t,) for t in text], "t string")
    assert [r[0] for r in df.select(to_day("t")).collect()] == [dt.date(2024, 3, 1)] * 2 + [dt.date(2024, 3, 2), None, None]


def test_argmax_ties_and_buckets(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.0), (0.0, 2.0, 2.0), (None, 1.0, 2.0)], "a double, b double, c double")
    assert [r[0] for r in df.select(argmax(["a", "b", "c"])).collect()] == [0, 1, None]
    assert [r[0] for r in df.select(bucket_of(F.col("b") * 15, [0, 15, 25, 999])).collect()] == [0.0, 2.0, 0.0]


def test_label_shares_and_embargo(spark):
    rng = np.random.default_rng(1)
    df = daily(spark, p=list(np.exp(np.cumsum(rng.normal(0, 0.02, 200)))))
    df = over_rows(df, ["s"], "d", [labels.forward_return("p", 7)], 0, 7).withColumns(labels.all_labels("return_future", 0.025))
    known = df.filter("return_future is not null")
    assert df.count() - known.count() == 7
    share = F.abs(F.col("target_mc_down") + F.col("target_mc_flat") + F.col("target_mc_up") - 1)
    assert known.agg(F.max(share)).first()[0] < 1e-12
    s = splits.chrono_split(known, ["s"], "d", 7)
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"train": int(193 * 0.7) - 7, "val": int(193 * 0.8) - 7 - int(193 * 0.7), "test": 193 - int(193 * 0.8)}


def test_constant_column_scales_to_zero(spark):
    df = daily(spark, a=[3.0] * 10).withColumn("split", F.when(F.col("d") < "2020-01-06", "train").otherwise("test"))
    assert set(column(splits.minmax_scale(df, ["s"], ["a"]), "a")) == {0.0}


def test_features_do_not_look_ahead(spark):
    rng = np.random.default_rng(5)
    p = list(10 + rng.normal(0, 0.1, 90).cumsum())
    cols = dict(open=p, high=[x + 0.2 for x in p], low=[x - 0.2 for x in p], close=p, volume=[1.0 + i % 7 for i in range(90)])
    a = market.daily_features(daily(spark, **cols), ["s"], 0.06).toPandas().set_index("d")
    changed = {k: v[:-3] + [x * 1.01 for x in v[-3:]] for k, v in cols.items()}
    b = market.daily_features(daily(spark, **changed), ["s"], 0.06).toPandas().set_index("d")
    # a despiked row looks one row ahead, so rows up to the one before the change are equal
    pd.testing.assert_frame_equal(a.iloc[:-4], b.iloc[:-4])


def test_single_class_and_ties(spark):
    df = spark.createDataFrame([("one", 1, 0.5), ("one", 1, 0.7), ("tie", 1, 0.5), ("tie", 0, 0.5)], "k string, y int, p double")
    for bounded in (True, False):
        out = {r["k"]: r for r in metrics.ranking_metrics(df, ["k"], "y", "p", bounded).collect()}
        assert out["one"]["auc_roc"] is None and out["one"]["pr_auc"] is None
        assert out["tie"]["auc_roc"] == 0.5 and out["tie"]["pr_auc"] == 0.5


def test_quantiles_of_a_hot_group(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": ["hot"] * 3000 + ["b"] * 7, "v": rng.normal(size=3007).round(2)})
    want = pdf.groupby("k").v.quantile([0.05, 0.5, 0.95]).unstack()
    for bounded in (True, False):
        got = metrics.quantiles(spark.createDataFrame(pdf), ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.95}, bounded)
        np.testing.assert_allclose(got.toPandas().set_index("k").loc[want.index, ["a", "b", "c"]], want)


def test_best_threshold_default(spark):
    df = spark.createDataFrame([("a", 0, 0.3), ("a", 0, 0.9)], "k string, y int, p double")
    assert metrics.best_f1_threshold(df, ["k"], "y", "p").first()["threshold"] == 0.05
    assert metrics.best_f1_threshold(df, ["k"], "y", "p", default=0.5).first()["threshold"] == 0.5


def test_backtest_against_numpy(spark):
    rng = np.random.default_rng(4)
    r = rng.normal(0.002, 0.03, 60)
    s = rng.integers(-1, 2, 60)
    df = daily(spark, r=list(r)).toPandas()
    df["signal"] = s
    got = B.summarize(spark.createDataFrame(df), ["s"]).first()
    strat = s * r
    eq = np.cumprod(1 + strat)
    peak = np.maximum.accumulate(eq)
    assert abs(got["sharpe"] - (strat.mean() - 0.04 / 52) / strat.std() * np.sqrt(52)) < 1e-9
    assert abs(got["max_drawdown"] - ((eq - peak) / peak).min()) < 1e-12
    assert abs(got["total_return"] - (eq[-1] - 1)) < 1e-12
    assert got["n_trades"] == int((s != 0).sum())
    assert abs(got["win_rate"] - (strat[s != 0] > 0).mean()) < 1e-12


def test_p_values(spark):
    # two-sided p-values of the t distribution, from tables
    rows = [(0.5, 10, 0.1411), (0.878339, 5, 0.05), (0.273244, 52, 0.05), (0.0, 20, 1.0), (1.0, 8, 0.0)]
    df = spark.createDataFrame([(r, n) for r, n, _ in rows], "r double, n long")
    got = [x[0] for x in df.select(lagscan.pearson_p("r", "n")).collect()]
    np.testing.assert_allclose(got, [p for *_, p in rows], atol=1e-4)


def test_report_documents(spark):
    good = '```json\n{"report_date":"2024-05-01","week_ending":"2024-05-05","national":{"planting_pct":40},"states":{"IOWA":{"planting_pct":50}},"notable_events":[],"signal":"meteor"}\n```'
    bad = good.replace('"planting_pct":50', '"planting_pct":150')
    df = spark.createDataFrame([(1, good), (2, bad), (3, "{broken")], "i int, t string")
    rows = {r["i"]: r for r in reports.parse_corn(df, "t", ["i"]).collect()}
    assert [rows[i]["accepted"] for i in (1, 2, 3)] == [True, False, False]
    assert rows[1]["signal"] == "on_track" and rows[1]["national"]["planting_pct"] == 40


def test_export_columns_are_checked(spark):
    df = spark.createDataFrame([("2024-05-05", "x")], "`Week Ending` string, State string")
    try:
        files.parse_export(df)
    except ValueError as e:
        assert "value" in str(e)
    else:
        raise AssertionError("missing columns were accepted")


def test_weather_with_null_prefix(spark):
    v = [None] * 3 + [10.0 + i % 4 for i in range(60)]
    cols = dict(temp_max=v, temp_min=v, et0=v, vpd_max=v, precip=[None if i % 5 == 0 else float(i % 3) for i in range(63)])
    out = weather.station_features(daily(spark, **cols), ["s"])
    assert out.count() == 63 - 3 - 29
    assert not set(out.columns) & {"__rn"}
