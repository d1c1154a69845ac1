"""Fits: early stopping, penalties."""

import numpy as np
from pyspark.sql import functions as F

from harrow.operators import models as X


def test_rank_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(0)
    n = 300
    m = rng.random((n, 2))
    r = 0.03 * (m[:, 0] - 0.5) + 0.01 * rng.standard_normal(n)
    rows = [(1, "val" if i < 250 else "test", float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(m, r))]
    df = spark.createDataFrame(rows, "tag int, split string, m1 double, m2 double, r double")
    out = X.stack_rank_ridge(df, ["tag"], ["m1", "m2"], "r", bounded=True).toPandas()
    fit = out[out.split == "val"]
    x, y = fit[["rank_m1", "rank_m2"]].to_numpy(), fit.r.to_numpy()
    c = x - x.mean(axis=0)
    w = np.linalg.solve(c.T @ c + 0.1 * np.eye(2), c.T @ (y - y.mean()))
    want = y.mean() + (out[["rank_m1", "rank_m2"]].to_numpy() - x.mean(axis=0)) @ w
    np.testing.assert_allclose(out.y_hat, want, atol=1e-6)


def test_logistic_per_key_is_the_penalised_optimum(spark):
    """Coefficients against Newton steps on one key at a time; a key of one class, missing values."""
    from harrow.operators.linear import logistic_by

    rng = np.random.default_rng(4)
    rows, want = [], {}
    for tag in range(3):
        x = rng.random((200, 2))
        y = (rng.random(200) < 1 / (1 + np.exp(-(tag + 1) * (x[:, 0] - 0.7)))).astype(float)
        rows += [(tag, *map(float, v), float(k)) for v, k in zip(x, y)]
        design, beta, w = np.column_stack([np.ones(200), x]), np.zeros(3), np.where(y == 1, 100 / y.sum(), 100 / (200 - y.sum()))
        for _ in range(50):
            p = 1 / (1 + np.exp(-design @ beta))
            pull = np.array([0, 1, 1]) / 0.5
            beta = beta + np.linalg.solve((design * (w * p * (1 - p))[:, None]).T @ design + np.diag(pull), design.T @ (w * (y - p)) - pull * beta)
        want[tag] = beta
    rows += [(7, 0.1, 0.2, 1.0), (7, 0.3, 0.1, 1.0), (0, None, 0.5, 1.0), (1, 0.5, 0.5, None)]
    got = {r["tag"]: [r[f"beta_{i}"] for i in range(3)] for r in logistic_by(spark.createDataFrame(rows, "tag int, a double, b double, y double"), ["tag"], ["a", "b"], "y", 0.5).collect()}
    for tag in range(3):
        np.testing.assert_allclose(got[tag], want[tag], atol=1e-7)
    assert got[7] == [0.0, 0.0, 0.0]


def test_boosting_keeps_the_trees_that_help(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 3))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int)
    rows = [(*map(float, a), int(b), "val" if i % 5 == 0 else "train") for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int, split string")
    fit = lambda t, rounds, patience: X.fit_boosted(X._fit_rows(t), ["a", "b", "c"], "logistic", X.Growth(rounds=rounds, patience=patience, rate=0.3), label="y")
    model = fit(df, 25, 10)
    assert 1 < model.best[0] <= 25
    noise = df.withColumn("y", (F.rand(5) > 0.5).cast("int"))
    stopped = fit(noise, 60, 5)
    assert len(stopped.trees) < 60 and stopped.best[0] < len(stopped.trees)


def test_forest_rows_are_even_and_node_sums_are_taken_in_small_groups(spark, monkeypatch):
    """No pass waits for one large partition, all training rows take part, and the sums of a pass are bounded."""
    rng = np.random.default_rng(6)
    rows = [(float(a), float(b), int(a > 0), float(a), "train" if i % 4 else "test") for i, (a, b) in enumerate(rng.standard_normal((900, 2)))]
    df = spark.createDataFrame(rows, "a double, b double, y int, r double, split string").coalesce(1)
    as_it_lies, sums = X._even(X._train(df, ["a", "b"], "y"))
    assert sums == {} and as_it_lies.rdd.getNumPartitions() == 1
    monkeypatch.setattr(X, "FOREST_ROWS", 20)
    cores = spark.sparkContext.defaultParallelism
    laid, sums = X._even(X._train(df, ["a", "b"], "y"))
    sizes = [r["count"] for r in laid.groupBy(F.spark_partition_id()).count().collect()]
    assert laid.rdd.getNumPartitions() % cores == 0 and sum(sizes) == 675 and max(sizes) <= 20 + 1
    assert sums["maxMemoryInMB"] <= 8
    model = X.fit_forest(df, ["a", "b"], "y", rounds=20)
    assert model.getNumTrees == 20 and model.featureImportances[0] > 0.8
    scored = X.probability(model, X.assembled(df, ["a", "b"])).select("y", "p").toPandas()
    assert ((scored.p > 0.5) == (scored.y == 1)).mean() > 0.95
    assert X.fit_forest_regression(df, ["a", "b"], "r", rounds=5).getNumTrees == 5
