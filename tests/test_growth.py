"""Size of a task, work per series and rows that are shuffled, as tables grow."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from harrow.operators import backtest as B
from harrow.operators import lagscan as G
from harrow.sources import tables as t


def lines(spark, path, symbols, days):
    """Line items of some suppliers, one a day."""
    rows = [(s * 1000 + k, 1, s, float(1000 + (s * 31 + k * 17) % 977), 0.05, 0.02, float(1 + (s + k * 7) % 50), dt.datetime(2000, 1, 3) + dt.timedelta(k)) for s in range(symbols) for k in range(days)]
    kind = "l_orderkey long, l_linenumber int, l_suppkey long, l_extendedprice double, l_discount double, l_tax double, l_quantity double, l_shipdate timestamp_ntz"
    spark.createDataFrame(rows, kind).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_bars_have_more_partitions_as_the_table_grows(spark, tmp_path, monkeypatch):
    sf = lines(spark, tmp_path, 60, 20)
    monkeypatch.setattr(t, "LAYOUT_ROWS", 100)
    bars = t.bars(spark, sf)
    assert bars.rdd.getNumPartitions() == 12
    assert bars.count() == 1200 and bars.select("symbol").distinct().count() == 60
    assert t.predictions(spark, sf).rdd.getNumPartitions() == 12
    assert t.layout_parts(spark, 0) == 1


def test_draws_are_summed_in_one_row_per_key(spark):
    """No row per slot or draw is shuffled; sums and ratios are those of a plain version."""
    rng = np.random.default_rng(3)
    values = {1: rng.normal(0, 0.1, 9), 2: np.full(5, 0.1), 3: np.array([0.2])}
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(i), float(x)) for k, v in values.items() for i, x in enumerate(v)] + [(4, dt.date(2020, 1, 1), None), (None, dt.date(2020, 1, 1), 0.3)]
    trades = spark.createDataFrame(rows, "tag int, d date, strat double")
    out = {r["tag"]: r for r in B.bootstrap_draws(trades, ["tag"], "strat", 40).collect()}
    assert sorted(out, key=str) == [1, 2, 3, 4, None]
    for k, v in values.items():
        n = len(v)
        for b in range(1, 41):
            x = [v[((b * 7919 + j * 104729) % 1000003 * ((b * 31 + j * 17 + 7) % 999983) + b * j) % 2147483647 % n] for j in range(n)]
            assert abs(out[k]["total"][b - 1] - sum(x)) < 1e-12
            if len(set(x)) == 1:
                assert out[k]["sharpe"][b - 1] is None
            else:
                assert abs(out[k]["sharpe"][b - 1] - (np.mean(x) - B.RISK_FREE / B.PERIODS) / np.std(x) * np.sqrt(B.PERIODS)) < 1e-9
    assert set(out[4]["total"]) == {None} and out[4]["n"] == 1
    assert [r["tag"] for r in B.bootstrap_sharpe(trades, ["tag"], draws=40).collect()] == [1]


def test_lag_scan_moves_series_not_draws_or_windows(spark):
    rng = np.random.default_rng(4)
    rows = [(k, dt.date(2020, 1, 6) + dt.timedelta(weeks=i), float(rng.integers(0, 50)) if k else 3.0, float(rng.random())) for k in range(4) for i in range(90)]
    df = spark.createDataFrame(rows, "symbol int, d date, x double, y double")
    seen = G.static_scan(df, ["symbol"], "d", "x", "y", 6)
    draws = G.null_scan(df, ["symbol"], "d", "x", "y", 30, 6)
    plain = {(r["symbol"], r["lag"]): (r["r"], r["p"]) for r in G.permutation_p(seen, draws, ["symbol"], 30).collect()}
    counted = G.permutation_p(seen, G.null_scan(df, ["symbol"], "d", "x", "y", 30, 6, seen=seen), ["symbol"], 30)
    assert {(r["symbol"], r["lag"]): (r["r"], r["p"]) for r in counted.collect()} == plain
    assert len(plain) == 24 and all(plain[0, lag] == (None, 0.0) for lag in range(1, 7))
    one = {(r["lag"], r["b"]): r["r"] for r in draws.filter("symbol = 2").collect()}
    x, y = [np.array([r[c] for r in rows if r[0] == 2]) for c in (2, 3)]
    for lag, b in ((1, 1), (6, 30)):
        j = range(90 - lag)
        order = sorted(j, key=lambda i: (((b * 7919 + i * 104729) % 1000003 * ((b * 31 + i * 17 + 7) % 999983) + b * i) % 2147483647, i))
        assert abs(one[lag, b] - np.corrcoef(x[order], y[lag:])[0, 1]) < 1e-12
    lags = spark.createDataFrame([(1, 2), (2, 5), (2, 7)], "symbol int, lag int")
    windows = G.rolling_scan(df, ["symbol"], "d", "x", "y", lags)
    assert {(r["symbol"], r["lag"]) for r in windows.select("symbol", "lag").distinct().collect()} == {(1, 2), (2, 5), (2, 7)}
    plan = windows._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "hashpartitioning(" in line and "lag" in line.split("hashpartitioning(")[1]]


def test_stacks_read_the_predictions_once(spark, tmp_path, monkeypatch):
    """One pass makes returns, predictions of all models and splits; rows and splits are those of the returns."""
    from harrow.catalog import fits
    from harrow.operators import joins as J
    from harrow.operators import splits as S

    sf = lines(spark, tmp_path, 6, 120)
    own, calls = t.returns, []
    monkeypatch.setattr(t, "returns", lambda *a, **k: calls.append(a) or own(*a, **k))
    out = {(r["tag"], r["d"]): r["split"] for r in fits.meta(spark, sf).collect()}
    assert len(calls) == 1
    plain = S.chrono_split(own(spark, sf).select("tag", "d"), ["tag"], "d", 7)
    assert out == {(r["tag"], r["d"]): r["split"] for r in plain.collect()} and {"train", "val", "test"} == set(out.values())
    wide = J.models_wide(t.predictions(spark, sf), ["tag", "d"], "model", [1, 2, 3, 4], "p", ["y_true"])
    assert "Join" not in fits.split_wide(wide)._jdf.queryExecution().executedPlan().toString()


def test_complete_rows_are_those_of_na_drop(spark):
    """NaN counts as missing, in any numeric type; text only where null."""
    from harrow.operators.features import complete

    nan = float("nan")
    rows = [(1, 1.0, "a"), (2, None, "a"), (3, nan, "a"), (4, 1.0, None), (None, 1.0, "a"), (6, float("inf"), ""), (7, 0.0, "NaN")]
    df = spark.createDataFrame(rows, "i int, x double, s string").withColumn("f", F.col("x").cast("float"))
    assert sorted(map(str, complete(df).collect())) == sorted(map(str, df.na.drop(how="any").collect()))
    assert complete(df).count() == 3


def test_empty_columns_are_found_a_few_at_a_time(spark):
    from harrow.operators.features import drop_all_null_columns

    df = spark.createDataFrame([(1, None, None, 2.0, None), (None, None, "x", None, None)], "a int, b int, c string, d double, e double")
    for at_once in (None, 1, 2, 12):
        assert drop_all_null_columns(df, at_once).columns == ["a", "c", "d"]
    assert drop_all_null_columns(df.filter("a > 5"), 2).columns == []


def test_exponential_means_in_one_sort(spark):
    """Ordered by segment, all layers share a sort; the values are those of the order by day."""
    from harrow.operators.ordered import SEGMENT, ewm_layers, ewm_reach, over_rows, side_by_side

    day, rng = dt.date(2000, 1, 1), np.random.default_rng(4)
    n = SEGMENT + 150
    rows = [(k, day + dt.timedelta(i), float(v) if rng.random() > 0.1 else None) for k in (1, 2) for i, v in enumerate(rng.standard_normal(n))]
    df = spark.createDataFrame(rows, "k int, d date, x double")
    lag = lambda name, c: lambda ctx: {name: F.lag(c, 3).over(ctx.w)}
    stack = lambda: [*side_by_side(ewm_layers("a", "x", 12), ewm_layers("b", "x", 26)), lag("l", "a"), *ewm_layers("c", "l", 9), lag("m", "c")]
    plain, seg = (over_rows(df, ["k"], "d", stack(), before=3 * ewm_reach(26), segmented=s) for s in (False, True))
    sorts = lambda x: x._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Sort [")
    assert sorts(seg) == 2 < sorts(plain)
    assert plain.columns == seg.columns
    assert sorted(plain.collect(), key=str) == sorted(seg.collect(), key=str)


def test_integrated_table_keeps_columns_no_layer_looks_at(spark):
    """Columns that travel through the windows as one come out where they were, and a new column replaces one of the same name."""
    from harrow.plans.integrate import integrate

    day = dt.date(2010, 1, 4)
    rows = [(1, day + dt.timedelta(i), 10.0 + i % 7, 11.0 + i % 7, 9.0, 5.0 + i % 3, float(i), -1.0) for i in range(60)]
    market = spark.createDataFrame(rows, "symbol int, d date, close double, high double, low double, volume double, extra double, hl_expansion double")
    usd = spark.createDataFrame([(r[1], 2.0 + r[0] % 2 + (k % 5) / 10, "u") for k, r in enumerate(rows)], "d date, close double, name string")
    out = integrate(market, ["symbol"], {"usd_": usd}, drop_empty=False)
    assert out.columns.index("extra") < out.columns.index("usd_close") < out.columns.index("usd_name")
    assert out.columns.count("hl_expansion") == 1
    got = {r["d"]: r for r in out.collect()}
    assert got and all(r["extra"] == (d - day).days and r["usd_name"] == "u" and r["hl_expansion"] > 0 for d, r in got.items())
    assert "__rest" in out._jdf.queryExecution().optimizedPlan().toString()


def test_crops_are_laid_out_by_symbol_as_bars_grow(spark, tmp_path, monkeypatch):
    """Windows of a crop follow the layout of its series and are not shuffled again."""
    from harrow.catalog import jobs

    sf = lines(spark, tmp_path, 60, 120)
    monkeypatch.setattr(t, "LAYOUT_ROWS", 100)
    monkeypatch.setattr(jobs, "cal_week", lambda *a: None)
    monkeypatch.setattr(jobs, "backbone", lambda *a: None)
    shared = dict.fromkeys(("usd_", "inf_", "vix_"))
    bars = jobs.cut(t.bars(spark, sf), "bars")
    for crop, odd in (("corn", 1), ("coffee", 0)):
        daily, _, _ = jobs.crop_sources(spark, sf, crop, bars, shared)
        assert daily.rdd.getNumPartitions() == 36
        assert {r["symbol"] for r in daily.select("symbol").distinct().collect()} == {i for i in range(60) if i % 2 == odd}
        assert daily._jdf.queryExecution().sparkPlan().toString().count("Exchange") <= 1


def test_bounded_ranks_stay_in_the_layout_of_their_keys(spark):
    """Ranks by windows are those of the table of distinct values, and move no row; ties, repeated rows, missing values and keys."""
    from harrow.operators.metrics import rank_fraction

    rng = np.random.default_rng(11)
    rows = [(int(k), s, float(v) if v else None, i) for i, (k, s, v) in enumerate(zip(rng.integers(0, 5, 300), rng.choice(["val", "test"], 300), rng.integers(0, 9, 300)))]
    rows += [(1, "val", float("nan"), 900), (1, "val", -0.0, 901), (1, "val", 0.0, 902), (None, "val", 1.0, 903), (2, None, 1.0, 904), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "tag int, split string, v double, i int").repartition(7, "tag")
    ranked = rank_fraction(df, ["tag", "split"], "v", "rank", bounded=True)
    plain = rank_fraction(df, ["tag", "split"], "v", "rank")
    take = lambda t: sorted((r["i"], r["rank"]) for r in t.select("i", "rank").fillna(-1.0, ["rank"]).collect())
    assert take(ranked) == take(plain) and len(take(ranked)) == len(rows)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
