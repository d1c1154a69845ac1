"""Both physical forms of the ordered operators against pandas, on series of very unequal length."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from harrow.functions import rolling as R
from harrow.operators import clean, ordered
from harrow.operators.ordered import Run, ewm_layers, ewm_reach, hold, over_rows, positions, running, running_by_value, side_by_side


@pytest.fixture(scope="module")
def series():
    """One series holds half of all rows; gaps at the start, inside and at the end."""
    rng = np.random.default_rng(3)
    parts = []
    for key, n in (("hot", 400), ("b", 150), ("c", 149), ("d", 1)):
        v = rng.normal(10, 3, n)
        v[rng.random(n) < 0.25] = np.nan
        if n > 10:
            v[:4] = np.nan
            v[-3:] = np.nan
        seq = np.sort(rng.choice(np.arange(5 * n), n, replace=False))
        parts.append(pd.DataFrame({"k": key, "seq": seq, "v": v, "f": (rng.random(n) < 0.6).astype(int)}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(params=["plain", "blocked"])
def form(request, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 16)
    return {"blocked": request.param == "blocked", "parts": 13}


@pytest.fixture(scope="module")
def frame(spark, series):
    df = spark.createDataFrame(series)
    return df.withColumn("v", F.when(~F.isnan("v"), F.col("v"))).cache()


def collected(df, cols):
    out = df.toPandas().sort_values(["k", "seq"]).reset_index(drop=True)
    return out[cols].astype(float)


def expected(series, fn):
    s = series.sort_values(["k", "seq"])
    return s.groupby("k", group_keys=False)[["seq", "v", "f"]].apply(fn).reset_index(drop=True).astype(float)


def same(got, want, tol=1e-9):
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), rtol=tol, atol=tol, equal_nan=True)


def test_positions(frame, series, form):
    got = collected(positions(frame, ["k"], "seq", "rn", "n", **form), ["rn", "n"])
    want = expected(series, lambda g: pd.DataFrame({"rn": np.arange(1, len(g) + 1), "n": len(g)}))
    same(got, want)


def test_bounded_frames(frame, series, form):
    layer = lambda c: {
        "mean": R.mean(c, "v", 3), "std": R.std(c, "v", 2), "part": R.mean_partial(c, "v", 7),
        "lag": R.shift(c, "v", 5), "lead": R.shift(c, "v", -2),
    }
    got = collected(over_rows(frame, ["k"], "seq", [layer], 7, 2, **form), ["mean", "std", "part", "lag", "lead"])
    want = expected(series, lambda g: pd.DataFrame({
        "mean": g.v.rolling(3).mean(), "std": g.v.rolling(2).std(), "part": g.v.rolling(7, min_periods=1).mean(),
        "lag": g.v.shift(5), "lead": g.v.shift(-2)}))
    same(got, want)


@pytest.mark.parametrize("span", [3, 9])
def test_ewm(frame, series, form, span):
    out = over_rows(frame, ["k"], "seq", ewm_layers("e", "v", span), ewm_reach(span), **form)
    same(collected(out, ["e"]), expected(series, lambda g: pd.DataFrame({"e": g.v.ewm(span=span).mean()})))


def test_ewm_over_long_gap(spark, form, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 4096)
    rng = np.random.default_rng(1)
    v = rng.normal(10, 3, 12_000)
    v[3000:8950] = np.nan
    pdf = pd.DataFrame({"k": "a", "seq": np.arange(len(v)), "v": v})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    out = over_rows(df, ["k"], "seq", ewm_layers("e", "v", 9), ewm_reach(9), **form)
    got = hold(out, ["k"], "seq", ["e"]).orderBy("seq").toPandas()["e"].to_numpy()
    np.testing.assert_allclose(got, pdf.v.ewm(span=9).mean().to_numpy(), rtol=1e-9)


def test_value_ranges_follow_the_rows(spark, monkeypatch):
    """An outlier and a hot key do not gather rows in one range."""
    n = 20_000
    df = spark.range(n).select(F.when(F.col("id") % 10 < 7, "hot").otherwise("b").alias("k"), (F.rand(3) * 100).alias("v"), F.lit(1).alias("one"))
    df = df.unionByName(df.limit(1).withColumn("v", F.lit(1e9)))
    keep, seen = ordered.laid_out, []

    def watch(*args):
        out = keep(*args)
        seen.extend(r["count"] for r in out.groupBy("k", "__t").count().collect())
        return out

    monkeypatch.setattr(ordered, "laid_out", watch)
    out = running_by_value(df, ["k"], "v", {"total": Run("sum", F.col("one"))}, piece_rows=500).toPandas()
    assert max(seen) < 3 * 500
    for _, g in out.sort_values("v").groupby("k"):
        assert g.total.tolist() == list(range(1, len(g) + 1))


def test_ewm_recursive_and_short_segments(frame, series, form, monkeypatch):
    monkeypatch.setattr(ordered, "SEGMENT", 1)
    filled = clean.forward_fill(frame, ["k"], "seq", ["v"], **form)
    layers = side_by_side(ewm_layers("e", "v", 5, adjust=False), ewm_layers("a", "v", 5))
    out = over_rows(filled, ["k"], "seq", layers, ewm_reach(5), **form)

    def want(g):
        v = g.v.ffill()
        return pd.DataFrame({"e": v.ewm(span=5, adjust=False).mean(), "a": v.ewm(span=5).mean()})

    same(collected(out, ["e", "a"]), expected(series, want))


def test_running(frame, series, form):
    specs = {
        "ff": Run("last", F.col("v")), "bf": Run("first", F.col("v")), "cum": Run("sum", F.col("f")),
        "peak": Run("max", F.col("v")), "prod": Run("product", 1 + F.col("f") / 100),
    }
    got = collected(running(frame, ["k"], "seq", specs, **form), list(specs))
    want = expected(series, lambda g: pd.DataFrame({
        "ff": g.v.ffill(), "bf": g.v.bfill(), "cum": g.f.cumsum(), "peak": g.v.cummax().ffill(),
        "prod": (1 + g.f / 100).cumprod()}))
    same(got, want)


def test_interpolate(frame, series, form):
    got = collected(clean.interpolate(frame, ["k"], "seq", ["v"], **form), ["v"])
    same(got, expected(series, lambda g: pd.DataFrame({"v": g.v.interpolate(method="linear")})))


def test_runs(frame, series, form):
    out = clean.run_length(frame, ["k"], "seq", ["f"], suffix="_len", **form)
    out = clean.run_totals(out, ["k"], "seq", ["f"], **form)

    def want(g):
        block = (g.f != g.f.shift()).cumsum()
        return pd.DataFrame({"f_len": g.f.groupby(block).cumsum(), "f_run": g.f.groupby(block).transform("sum")})

    same(collected(out, ["f_len", "f_run"]), expected(series, want))


def test_blocked_plan_never_partitions_rows_by_series_alone(frame):
    """In the blocked form only block summaries meet in one window per series."""
    out = over_rows(frame, ["k"], "seq", [lambda c: {"m": R.mean(c, "v", 3)}], 3, blocked=True)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("__t" in w or "__blk" in w or "__c" in w for w in windows)


@pytest.mark.parametrize("kind", ["microseconds", "timestamp", "timestamp_ntz", "text", "sparse"])
def test_any_order_column(spark, kind):
    """One key with nearly all rows, whatever the type and the unit of the order: even ranges, the same results."""
    n = 6000
    i = F.col("id")
    order = {
        "microseconds": 1_700_000_000_000_000 + i * 997, "timestamp": F.timestamp_micros(1_700_000_000_000_000 + i * 13), "text": F.lpad(i.cast("string"), 12, "0"),
        "timestamp_ntz": F.timestamp_micros(1_700_000_000_000_000 + i * 13).cast("timestamp_ntz"), "sparse": i * i * 1_000_003}[kind]
    df = spark.range(n).select(F.when(i % 50 == 0, "b").otherwise("hot").alias("k"), order.alias("o"), i, F.when(i % 7 > 0, i).alias("v"))
    sizes = [r["count"] for r in ordered.laid_out(df, ["k"], "o", 12).groupBy("__t").count().collect()]
    assert max(sizes) <= 3 * np.median(sizes) and len(sizes) >= 10
    out = positions(df, ["k"], "o", "rn", "n", blocked=True, parts=12)
    out = running(out, ["k"], "o", {"ff": Run("last", F.col("v")), "cum": Run("sum", F.lit(1)), "peak": Run("max", F.col("v"))}, blocked=True, parts=9)
    out = over_rows(out, ["k"], "o", [lambda c: {"lag": R.shift(c, "id", 2)}], 2, blocked=True, parts=7)
    for _, g in out.toPandas().sort_values("id").groupby("k"):
        assert g.rn.tolist() == g.cum.tolist() == list(range(1, len(g) + 1)) and set(g.n) == {len(g)}
        np.testing.assert_array_equal(g.ff, g.v.ffill())
        np.testing.assert_array_equal(g.peak, g.v.cummax().ffill())
        np.testing.assert_array_equal(g.lag, g.id.shift(2))
