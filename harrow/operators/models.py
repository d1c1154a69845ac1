"""Models fitted on distributed feature tables: boosted trees from `boosting`, forests and stacks from Spark ML.

Settings follow the inventory's. Every boosted fit takes `rounds`, the most trees it may grow. What is fitted several
times, on blocks, folds, shuffled labels or lists of features, is fitted at once.

Boosting stops early the way the settings ask for: the number of trees is the one with the least
validation loss, once `patience` further trees have not improved it.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import cut
from .boosting import Growth, Model, fit_boosted
from .linear import linear, logistic_by, ridge_by
from .metrics import rank_fraction
from .ordered import positions
from .splits import balanced_weights, expanding_folds

SEED = 42
# Settings of boosted trees per task, daily and weekly.
TREES = {
    ("binary", False): Growth(rounds=2000, rate=0.015, leaves=6, depth=4, least_rows=35, least_weight=5, least_gain=0.02, row_share=0.7, column_share=0.6, l1=1.0, l2=10.0, patience=30),
    ("binary", True): Growth(rounds=500, rate=0.01, leaves=4, depth=3, least_rows=10, least_weight=5, least_gain=0.02, row_share=0.7, column_share=0.5, l1=1.0, l2=10.0, patience=30),
    ("multiclass", False): Growth(rounds=2000, rate=0.02, leaves=7, depth=4, least_rows=30, least_weight=5, row_share=0.7, column_share=0.6, l1=1.0, l2=5.0, patience=50),
    ("multiclass", True): Growth(rounds=500, rate=0.01, leaves=4, depth=3, least_rows=10, least_weight=5, row_share=0.7, column_share=0.5, l1=1.0, l2=10.0, patience=50),
    ("regression", False): Growth(rounds=2000, rate=0.02, leaves=63, depth=5, least_rows=30, least_weight=5, row_share=0.8, column_share=0.7, l1=0.1, l2=1.0, patience=50),
    ("regression", True): Growth(rounds=500, rate=0.01, leaves=15, depth=3, least_rows=10, least_weight=5, row_share=0.8, column_share=0.6, l1=0.1, l2=5.0, patience=50),
    ("magnitude", False): Growth(rounds=500, rate=0.05, leaves=15, depth=4, least_rows=5, least_weight=1, row_share=0.8, column_share=0.7, l1=0.1, l2=0.5, patience=50),
    ("magnitude", True): Growth(rounds=300, rate=0.05, leaves=7, depth=3, least_rows=3, least_weight=1, row_share=0.8, column_share=0.6, l1=0.1, l2=1.0, patience=50),
}
# Fixed value: weight cap of positives.
CAP = 10.0
#: Training rows up to which a forest is fitted as they lie; beyond, so many make a partition, and nodes are summed in groups of so many
#: MB, which stay in a core's cache, and not all trees at once.
FOREST_ROWS = 50_000
GROUP_MB = 4
FOREST = {
    ("class", False): dict(numTrees=500, maxDepth=5, minInstancesPerNode=20, featureSubsetStrategy="0.5"),
    ("class", True): dict(numTrees=200, maxDepth=3, minInstancesPerNode=30, featureSubsetStrategy="0.4"),
    ("regression", False): dict(numTrees=400, maxDepth=4, minInstancesPerNode=30, featureSubsetStrategy="0.4"),
    ("regression", True): dict(numTrees=200, maxDepth=3, minInstancesPerNode=30, featureSubsetStrategy="0.4"),
}


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """Feature vector with missing values as 0."""
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    return VectorAssembler(inputCols=features, outputCol="features").transform(filled)


def growth(kind: str, weekly: bool, rounds: int | None) -> Growth:
    out = TREES[kind, weekly]
    return replace(out, rounds=rounds) if rounds else out


def _forest_params(kind: str, weekly: bool, rounds: int | None) -> dict:
    out = dict(FOREST[kind, weekly], seed=SEED)
    return out | {"numTrees": rounds} if rounds else out


def _fit_rows(df: DataFrame, split: str = "split") -> DataFrame:
    """Training and validation rows, the latter marked for early stopping."""
    return df.filter(F.col(split).isin("train", "val")).withColumn("is_val", F.col(split) == "val")


def probability(model, df: DataFrame, cls: int = 1, out: str = "p") -> DataFrame:
    scored = model.transform(df)
    return scored.withColumn(out, F.get(vector_to_array("probability"), F.lit(cls))).drop(
        "rawPrediction", "probability", "prediction"
    )


def fit_gbt_binary(df: DataFrame, features: list[str], label: str, weekly: bool = False, rounds: int | None = None, ident: list[str] = ()) -> Model:
    """Boosted trees; positives weigh (negatives / positives), capped; stops early on validation."""
    return fit_boosted(_fit_rows(df), features, "logistic", growth("binary", weekly, rounds), label=label, ident=ident, cap=CAP)


def fit_gbt_multiclass(df: DataFrame, features: list[str], label: str, classes: int = 3, weekly: bool = False, rounds: int | None = None, ident: list[str] = ()) -> Model:
    """One softmax model: a tree per class and round from the gradients of the joint loss; balanced rows. Labels are 0, 1, .."""
    return fit_boosted(_fit_rows(df), features, "softmax", growth("multiclass", weekly, rounds), outputs=classes, label=label, ident=ident, balanced=True)


def fit_gbt_regression(df: DataFrame, features: list[str], label: str, kind: str = "regression", weekly: bool = False, rounds: int | None = None, ident: list[str] = ()) -> Model:
    return fit_boosted(_fit_rows(df), features, "squared", growth(kind, weekly, rounds), label=label, ident=ident)


def scored(model: Model, df: DataFrame, out: list[str], fit: str | None = None) -> DataFrame:
    """Adds a column per output of a boosted model."""
    got = model.predict(df, fit, "__scores")
    return got.withColumns({name: F.get("__scores", F.lit(k)) for k, name in enumerate(out)}).drop("__scores")


def _train(df: DataFrame, features: list[str], label: str) -> DataFrame:
    return assembled(df.filter(F.col("split") == "train"), features).select(label, "features")


def _even(rows: DataFrame) -> tuple[DataFrame, dict]:
    """Rows of a large forest in even partitions, a multiple of the cores, as it takes many passes and each ends with its last task; and
    how its nodes are summed."""
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    if n <= FOREST_ROWS:
        return rows, {}
    return rows.repartition(cores * -(-n // (cores * FOREST_ROWS))), {"maxMemoryInMB": GROUP_MB}


def fit_forest(df: DataFrame, features: list[str], label: str, weekly: bool = False, rounds: int | None = None):
    """Random forest for two or more classes with balanced rows."""
    rows, sums = _even(balanced_weights(_train(df, features, label), [], label))
    est = RandomForestClassifier(labelCol=label, weightCol="weight", **_forest_params("class", weekly, rounds), **sums)
    return est.fit(rows)


def fit_forest_regression(df: DataFrame, features: list[str], label: str, weekly: bool = False, rounds: int | None = None):
    rows, sums = _even(_train(df, features, label))
    return RandomForestRegressor(labelCol=label, **_forest_params("regression", weekly, rounds), **sums).fit(rows)


def predictions(model, df: DataFrame, features: list[str], out: str = "y_hat") -> DataFrame:
    return model.transform(assembled(df, features)).withColumnRenamed("prediction", out)


def importances(model, features: list[str], spark) -> DataFrame:
    """(feature, gain) of a fitted tree model."""
    gains = model.featureImportances.toArray()
    return spark.createDataFrame([(f, float(g)) for f, g in zip(features, gains)], "feature string, gain double")


def held_back(n: Column) -> Column:
    """How many of the last of n training rows stop the boosting: 15 %, at least 30."""
    return F.greatest(F.lit(30), F.floor(n * F.lit(0.15)))


def walkforward_gbt(blocks: DataFrame, keys: list[str], d: str, features: list[str], label: str, rounds: int | None = None) -> DataFrame:
    """Predictions of the test rows of each walk-forward block by a model of the block's rows.

    `blocks` has (block, role) from `splits.walkforward`; the last 15 % of a training window, at
    least 30 rows, stop the boosting early. All blocks are fitted at once.
    """
    train = positions(blocks.filter(F.col("role") == "train"), [*keys, "block"], d, "__i", "__m")
    train = train.withColumn("is_val", F.col("__i") > F.col("__m") - held_back(F.col("__m")))
    fits = (blocks.agg(F.max("block")).first()[0] or 0) + 1
    model = fit_boosted(train, features, "logistic", growth("binary", False, rounds), fits=fits, fit="block", label=label, ident=[*keys, d], cap=CAP)
    return scored(model, blocks.filter(F.col("role") == "test"), ["p"], "block").select(*keys, d, "block", F.col(label).alias("y_true"), "p")


def shuffled_labels(df: DataFrame, ident: list[str], label: str, runs: int, seed: int = SEED) -> DataFrame:
    """Adds `labels`: the row's own label, then its label in each of `runs` shuffles.

    Rows are numbered along a hash; run r gives number i the label of number (a i + b) mod n, a prime a that does not
    divide n. Only numbers and labels are joined, whatever the width of the rows, and no task sees the whole column.
    """
    numbered = positions(df.withColumn("__h", F.xxhash64(F.lit(seed), *ident)), [], "__h", "__no", "__n", blocked=True)
    numbered = cut(numbered.drop("__h"), "numbered")
    n = numbered.agg(F.max("__n")).first()[0] or 1
    steps = [p for p in (700001, 800011, 900001, 1000003, 1100009, 1200007, 1300021, 1400017, 1500007, 1600033, 1700021, 1800017) if n % p]
    if runs > len(steps):
        raise ValueError(f"at most {len(steps)} shuffles")
    moves = F.array(*[F.struct(F.lit(r).alias("run"), (((F.col("__no") - 1) * a + F.lit(7919 * (seed + r))) % n + 1).alias("__from")) for r, a in enumerate(steps[:runs])])
    drawn = numbered.select("__no", F.explode(moves).alias("m")).select("__no", "m.*")
    drawn = drawn.join(numbered.select(F.col("__no").alias("__from"), F.col(label).alias("__y")), "__from")
    drawn = drawn.groupBy("__no").agg(F.transform(F.sort_array(F.collect_list(F.struct("run", "__y"))), lambda m: m["__y"]).alias("__drawn"))
    out = numbered.join(drawn, "__no", "left") if runs else numbered.withColumn("__drawn", F.array().cast("array<double>"))
    return out.withColumn("labels", F.concat(F.array(F.col(label).cast("double")), F.col("__drawn").cast("array<double>"))).drop("__no", "__n", "__drawn")


def null_importance(df: DataFrame, features: list[str], label: str, ident: list[str], folds: int = 3, null_runs: int = 5, rounds: int = 50, keep: float = 0.05, regression: bool = False) -> DataFrame:
    """(feature, score, kept): splits on a feature over expanding folds less splits under shuffled
    labels, relative to the most; every feature is kept when none passes.

    `df` holds training rows with rn and n. Folds and runs are fitted at once.
    """
    folded = expanding_folds(shuffled_labels(df, ident, label, null_runs), folds).filter(F.col("role") == "train")
    rows = folded.select("*", F.posexplode("labels").alias("run", "__y")).withColumn("fit", F.col("run") * folds + F.col("fold")).withColumn("is_val", F.lit(False))
    fits = folds * (null_runs + 1)
    model = fit_boosted(rows.drop("labels"), features, "squared" if regression else "logistic", Growth(rounds=rounds), fits=fits, fit="fit", label="__y", ident=ident)
    used = model.splits.reshape(null_runs + 1, folds, len(features)).mean(axis=1)
    score = np.maximum(0.0, used[0] - (used[1:].mean(axis=0) if null_runs else 0.0)) / (used[0].max() + 1e-5)
    passed = score >= keep
    kept = passed if passed.any() else ~passed
    return df.sparkSession.createDataFrame([(f, float(s), bool(k)) for f, s, k in zip(features, score, kept)], "feature string, score double, kept boolean")


def variants_gbt(df: DataFrame, variants: dict[str, list[str]], label: str, ident: list[str], weekly: bool = False, rounds: int | None = None) -> DataFrame:
    """Validation and test rows of every variant of the feature list (column `experiment`) with its score p; all variants are
    fitted at once over one table of all features."""
    features = list(dict.fromkeys(c for v in variants.values() for c in v))
    only = np.array([[c in v for c in features] for v in variants.values()])
    names = F.array(*[F.lit(v) for v in variants])
    each = lambda t: t.select("*", F.posexplode(names).alias("fit", "experiment"))
    model = fit_boosted(each(_fit_rows(df)), features, "logistic", growth("binary", weekly, rounds), fits=len(variants), fit="fit", label=label, ident=ident, cap=CAP, only=only)
    return scored(model, each(df.filter(F.col("split").isin("val", "test"))), ["p"], "fit").drop("fit")


def stack_logistic(meta: DataFrame, keys: list[str], cols: list[str], label: str, c: float = 1.0, fit_split: str = "val") -> DataFrame:
    """All rows with p, the probability by a logistic regression per key with balanced classes and an L2 penalty, fitted on the
    rows of `fit_split`; keys without such rows get null."""
    fitted = logistic_by(meta.filter(F.col("split") == fit_split), keys, cols, label, c)
    return linear(meta, fitted, keys, cols, "p").withColumn("p", 1 / (1 + F.exp(-F.col("p"))))


def stack_multinomial(meta: DataFrame, cols: list[str], label: str, c: float = 1.0):
    """L2 multinomial regression with balanced rows on base predictions (rows of the fit only)."""
    rows = balanced_weights(assembled(meta, cols), [], label)
    n = rows.count()  # balanced weights sum to the number of rows
    est = LogisticRegression(labelCol=label, weightCol="weight", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=500, family="multinomial")
    return est.fit(rows)


def stack_rank_ridge(meta: DataFrame, keys: list[str], cols: list[str], label: str, alpha: float = 0.1, fit_split: str = "val", bounded: bool = False) -> DataFrame:
    """Ridge per key on rank-transformed base predictions; ranks are taken per key and split.

    Returns all rows with y_hat.
    """
    ranked = meta
    for c in cols:
        ranked = rank_fraction(ranked, [*keys, "split"], c, f"rank_{c}", bounded)
    feats = [f"rank_{c}" for c in cols]
    return linear(ranked, ridge_by(ranked.filter(F.col("split") == fit_split), keys, feats, label, alpha), keys, feats, "y_hat")


def blend(cols: list[str]) -> Column:
    """Equal-weight mean of base predictions."""
    return reduce(lambda a, b: a + b, [F.col(c) for c in cols]) / len(cols)


def hurdle_legs(df: DataFrame, r: str, theta: float) -> DataFrame:
    """Up and down subsets with the size of the move, as one table with a `leg` column."""
    leg = F.when(F.col("target_binary") == 1, "up").when(F.col(r) < -theta, "down")
    return df.withColumn("leg", leg).filter(F.col("leg").isNotNull()).withColumn(
        "magnitude", F.when(F.col("leg") == "up", F.col(r)).otherwise(-F.col(r))
    )


def hurdle_magnitudes(df: DataFrame, features: list[str], r: str, theta: float, weekly: bool = False, rounds: int | None = None, least: int = 20, ident: list[str] = ()) -> DataFrame:
    """All rows with the predicted size of an up move (m_up) and of a down move (m_down), at least 0.

    Both legs are fitted at once, each on the rows of its moves. A leg with fewer than `least` training rows predicts theta.
    """
    legs = hurdle_legs(df, r, theta).withColumn("fit", (F.col("leg") == "down").cast("int"))
    train = {x["fit"]: x["n"] for x in legs.filter(F.col("split") == "train").groupBy("fit").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = fit_boosted(_fit_rows(legs), features, "squared", growth("magnitude", weekly, rounds), fits=2, fit="fit", label="magnitude", ident=ident)
    out = df
    for k, name in enumerate(("m_up", "m_down")):
        if train.get(k, 0) < least:
            out = out.withColumn(name, F.lit(theta))
            continue
        out = scored(model, out.withColumn("__fit", F.lit(k)), [name], "__fit").withColumn(name, F.greatest(name, F.lit(0.0))).drop("__fit")
    return out


def hurdle_stage_one(df: DataFrame, features: list[str], r: str, theta: float, folds: int = 3, weekly: bool = False, rounds: int | None = None, ident: list[str] = ()) -> DataFrame:
    """Rows with p_up and p_down, the probabilities of a move above theta and below -theta, by models that have not seen them.

    `df` has split, and rn and n over the training rows of a series. Training rows are scored out of fold: expanding folds, each by models of the
    rows before it (the rows before the first fold are left out), of which the last stop the boosting; validation and test rows by models of
    all training rows, which stop on validation rows. All legs and folds are fitted at once.
    """
    up, down = (F.col(r) > theta).cast("double"), (F.col(r) < -theta).cast("double")
    legs = F.array(F.struct(F.lit(0).alias("leg"), up.alias("__y")), F.struct(F.lit(1).alias("leg"), down.alias("__y")))
    folded = expanding_folds(df.filter(F.col("split") == "train"), folds)
    own = F.col("n") - (folds - F.col("fold")) * F.floor(F.col("n") / (folds + 1))
    fit_rows = folded.filter(F.col("role") == "train").withColumn("is_val", F.col("rn") > own - held_back(own)).drop("role")
    fit_rows = fit_rows.unionByName(_fit_rows(df).withColumn("fold", F.lit(folds)))
    fit_rows = fit_rows.select("*", F.explode(legs).alias("l")).select("*", "l.*").withColumn("fit", F.col("leg") * (folds + 1) + F.col("fold"))
    model = fit_boosted(fit_rows.drop("l"), features, "logistic", growth("binary", weekly, rounds), fits=2 * (folds + 1), fit="fit", label="__y", ident=ident, cap=CAP)
    out = folded.filter(F.col("role") == "test").drop("role").unionByName(df.filter(F.col("split").isin("val", "test")).withColumn("fold", F.lit(folds)))
    for leg, name in enumerate(("p_up", "p_down")):
        out = scored(model, out.withColumn("__fit", F.col("fold") + leg * (folds + 1)), [name], "__fit").drop("__fit")
    return out.drop("fold")


def hurdle_expectation(p_up="p_up", m_up="m_up", p_down="p_down", m_down="m_down") -> dict[str, Column]:
    """Half (up leg only) and full expected return."""
    half = F.col(p_up) * F.col(m_up)
    return {"half_hurdle_pred": half, "full_hurdle_pred": half - F.col(p_down) * F.col(m_down)}
