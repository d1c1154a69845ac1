"""Shuffled arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.operators import splits as S


def draw_by_draw(x, b):
    """The values in the order of the hash of draw and position, then of the position."""
    key = lambda j: (((b * 7919 + j * 104729) % 1000003) * ((b * 31 + j * 17 + 7) % 999983) + b * j) % 2147483647
    return [x[j] for j in sorted(range(len(x)), key=lambda j: (key(j), j))]


@pytest.mark.parametrize("values", [2_000_000, 50])
def test_draws_are_those_of_single_sorts(spark, monkeypatch, values):
    """Arrays of several lengths, with missing values, an empty and a missing one; some rows at a time."""
    monkeypatch.setattr(S, "OUT_VALUES", values)
    rng = np.random.default_rng(2)
    rows = [(k, "t" if k % 2 else None, [float(v) if v > -1 else None for v in rng.standard_normal(n)]) for k, n in enumerate((1, 5, 40, 5, 0, 33))] + [(9, "none", None)]
    df = spark.createDataFrame(rows, "k int, t string, x array<double>").repartition(2)
    got = {(r["k"], r["b"]): r for r in S.permuted_arrays(df, ["k"], "x", 20).collect()}
    assert len(got) == 20 * len(rows)
    for k, t, x in rows:
        for b in range(1, 21):
            r = got[k, b]
            assert r["t"] == t and r["x"] == x and r["shuffled"] == (None if x is None else draw_by_draw(x, b))


def test_a_draw_is_not_sorted_for_each_array(spark):
    """Positions are sorted once per length and task, not by an expression per array."""
    df = spark.range(10).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("x"))
    plan = S.permuted_arrays(df, ["id"], "x", 300)._jdf.queryExecution().executedPlan().toString()
    assert "sort_array" not in plan and "MapInArrow" in plan
