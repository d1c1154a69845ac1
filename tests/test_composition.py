"""Scan, verdicts, packing and the store of predictions against plain versions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.operators import lagscan as G
from harrow.operators import packing
from harrow.sources import files, sinks


@pytest.fixture(scope="module")
def weekly(spark):
    rng = np.random.default_rng(8)
    rows = []
    for crop, n in (("corn", 130), ("coffee", 60)):
        a, b = rng.standard_normal((2, n))
        y = np.append([0.0] * 3, a[:-3]) + 0.3 * rng.standard_normal(n)
        rows += [(crop, dt.date(2020, 1, 6) + dt.timedelta(weeks=i), float(a[i]), float(b[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "crop string, d date, a double, b double, y double").cache()


def test_shared_shuffles_are_those_of_single_variables(weekly):
    found = G.shared_null_scan(weekly, ["crop"], "d", ["a", "b"], "y", draws=4, max_lag=10)
    got = {(r["variable"], r["crop"], r["lag"], r["b"]): r["r"] for r in found.collect()}
    want = {}
    for v in ("a", "b"):
        for r in G.null_scan(weekly, ["crop"], "d", v, "y", draws=4, max_lag=10).collect():
            want[v, r["crop"], r["lag"], r["b"]] = r["r"]
    assert got.keys() == want.keys() and len(got) == 2 * 2 * 10 * 4
    np.testing.assert_allclose([got[k] for k in want], list(want.values()), atol=1e-12)


def test_scan_finds_the_lag_and_verdicts_follow_it(weekly):
    found, tested = G.scan_all(weekly, ["crop"], "d", ["a", "b"], "y", draws=60)
    r = {(x["crop"], x["variable"], x["lag"]): (x["r"], x["p"]) for x in tested.collect()}
    rows = weekly.filter("crop = 'corn'").orderBy("d").toPandas()
    assert abs(r["corn", "a", 5][0] - np.corrcoef(rows.a[:-5], rows.y[5:])[0, 1]) < 1e-12
    assert r["corn", "a", 3][0] > 0.9 and r["corn", "a", 3][1] == 0
    assert not any(crop == "coffee" for crop, _, _ in r)  # too short for the scan
    todo = G.actions(G.lag_config(found, tested, ["crop", "variable"]), ["crop"])
    assert todo["corn",]["a"][3] == "shift_feature" and all(a != "shift_feature" for a in todo["corn",].get("b", {}).values())


@pytest.mark.parametrize("weekly_table", [False, True])
def test_windows_of_all_widths(spark, weekly_table):
    rng = np.random.default_rng(9)
    days, rows = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(70)], []
    for s in (1, 2):
        for i, day in enumerate(days):
            split = "train" if i < 50 else "test"
            rows.append((s, day, split, i, float(rng.random()), 5.0, float(i % 3), 7.0, None if i == 20 else float(rng.random()), float(i % 2), 0.2, 0.3, 0.5))
    df = spark.createDataFrame(rows, "symbol int, d date, split string, rn int, x double, flat double, site double, close double, gap double, target_binary double, "
                                     "target_mc_down double, target_mc_flat double, target_mc_up double")
    dynamic, static = packing.tensor_columns(df.drop("rn"), ["symbol"], ["site", "absent"])
    assert (dynamic, static) == (["x", "flat", "gap"], ["site"])
    widths = packing.WIDTHS[weekly_table]
    got = {(r["symbol"], r["split"], r["d"], r["win"]): r for r in packing.pack_table(df, ["symbol"], "d", widths, ["site"], ignore=["rn"]).collect()}
    want = 0
    for s in (1, 2):
        own = [r for r in rows if r[0] == s]
        lo, hi = min(r[4] for r in own[:50]), max(r[4] for r in own[:50])
        for split in ("train", "test"):
            part = [r for r in own if r[2] == split]
            for w in widths:
                for k in range(w - 1, len(part)):
                    r = got[s, split, part[k][1], w]
                    want += 1
                    np.testing.assert_allclose([v[0] for v in r["dynamic"]], [(x[4] - lo) / (hi - lo) for x in part[k - w + 1:k + 1]], atol=1e-12)
                    assert all(v[1] == 0.0 for v in r["dynamic"]) and r["static"] == [part[k][6] / 2] and r["y"] == part[k][9] and r["y_classes"] == [0.2, 0.3, 0.5]
                    assert (0.0 in [v[2] for v in r["dynamic"]]) >= any(x[8] is None for x in part[k - w + 1:k + 1])
    assert len(got) == want


def test_store_is_read_by_partition(spark, tmp_path):
    rows = spark.range(200).select(
        F.when(F.col("id") % 2 == 0, "corn").otherwise("coffee").alias("tag"), F.when(F.col("id") % 3 == 0, "val").otherwise("test").alias("split"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("d"), (F.col("id") / 200).alias("gbt"), (1 - F.col("id") / 200).alias("rf"))
    path = f"{tmp_path}/store"
    sinks.write_predictions(sinks.unpivoted_scores(rows, ["gbt", "rf"], ["tag", "split", "d"]), path)
    sinks.write_predictions(sinks.unpivoted_scores(rows.withColumn("stack", F.lit(0.5)), ["stack"], ["tag", "split", "d"]), path)
    out = files.read_predictions(spark, path, model="rf", split="val")
    assert out.count() == 67 and {r["model"] for r in out.select("model").distinct().collect()} == {"rf"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model" in plan and "PushedFilters: []" in plan
    assert files.read_predictions(spark, path).count() == 600
    assert files.read_predictions(spark, path, model="none").count() == 0
