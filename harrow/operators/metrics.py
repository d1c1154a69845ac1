"""Exact evaluation metrics as grouped jobs over a long prediction table.

Rank-based metrics work on a table of distinct scores with counts, scanned along value ranges,
so no group of raw rows is ever sorted in one task. `bounded` says that a key holds at most one
row per day, which makes one window per key the cheaper form.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nullsafe import pearson, ratio
from .ordered import Run, running_by_value

THRESHOLDS = 90  # 0.05, 0.06, .. 0.94


def rank_fraction(df: DataFrame, keys: list[str], c: str, out: str, bounded: bool = False) -> DataFrame:
    """Average rank of a value in its group over the group size.

    Ranks come from a table of distinct values with counts, scanned along value ranges. bounded: the caller knows that a key holds at
    most one row per day; then rows are ranked where a key's rows lie, with one sort, and a layout by keys is kept.
    """
    if bounded:
        group = [*keys, F.col(c).isNull()]
        whole = F.count(F.lit(1))
        ties = whole.over(Window.partitionBy(*group, c))
        upto = whole.over(Window.partitionBy(*group).orderBy(c).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in (*keys, c)])
        return df.withColumn(out, F.when(known, (upto - ties + (ties + 1) / 2.0) / whole.over(Window.partitionBy(*group))))
    counts = df.filter(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count(F.lit(1)).alias("__c"))
    below = running_by_value(counts, keys, c, {"__cum": Run("sum", F.col("__c"))})
    size = counts.groupBy(*keys).agg(F.sum("__c").alias("__size"))
    rank = F.col("__cum") - F.col("__c") + (F.col("__c") + 1) / 2.0
    ranked = below.join(size, keys).select(*keys, c, (rank / F.col("__size")).alias(out))
    return df.join(ranked, [*keys, c], "left")


def quantiles(
    df: DataFrame, keys: list[str], c: str, qs: dict[str, float], bounded: bool = False
) -> DataFrame:
    """Exact linearly interpolated quantiles per key.

    Distinct values with cumulative counts give both neighbouring order statistics, so no group
    has to fit into one aggregation buffer.
    """
    counts = df.filter(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count(F.lit(1)).alias("__c"))
    cum = running_by_value(counts, keys, c, {"__cum": Run("sum", F.col("__c"))}, bounded)
    size = counts.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    rows = cum.join(size, keys)

    def position(q: float) -> Column:
        return (F.col("__n") - 1) * F.lit(q)

    def order_stat(i: Column, name: str) -> Column:
        return F.min(F.when(F.col("__cum") > i, F.col(c))).alias(name)

    stats = [
        order_stat(f(position(q)), f"__{side}_{name}")
        for name, q in qs.items()
        for side, f in (("lo", F.floor), ("hi", F.ceil))
    ]
    out = rows.groupBy(*keys, "__n").agg(*stats)

    def between(name: str, q: float) -> Column:
        lo, hi, p = F.col(f"__lo_{name}"), F.col(f"__hi_{name}"), position(q)
        return (lo + (hi - lo) * (p - F.floor(p))).alias(name)

    return out.select(*keys, *[between(n, q) for n, q in qs.items()])


def score_table(df: DataFrame, keys: list[str], y: str, score: str, bounded: bool = False) -> DataFrame:
    """Distinct scores per key with positives, negatives, and both counts at or below the score."""
    pos = F.col(y).cast("long")
    counts = df.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(
        F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg")
    )
    specs = {"cum_pos": Run("sum", F.col("pos")), "cum_neg": Run("sum", F.col("neg"))}
    return running_by_value(counts, keys, score, specs, bounded)


def ranking_metrics(df: DataFrame, keys: list[str], y: str, score: str, bounded: bool = False) -> DataFrame:
    """auc_roc (ties count half) and pr_auc (average precision, ties as one step).

    auc_roc is null with one class only, pr_auc with no positives.
    """
    s = score_table(df, keys, y, score, bounded)
    if bounded:
        w = Window.partitionBy(*keys)
        s = s.withColumns({"__p": F.sum("pos").over(w), "__n": F.sum("neg").over(w)})
    else:
        totals = df.filter(F.col(score).isNotNull()).groupBy(*keys).agg(
            F.sum(F.col(y).cast("long")).alias("__p"), F.sum(1 - F.col(y).cast("long")).alias("__n")
        )
        s = s.join(totals, keys)
    pairs = F.sum(F.col("pos") * ((F.col("cum_neg") - F.col("neg")) + F.col("neg") / 2.0))
    tp = F.col("__p") - (F.col("cum_pos") - F.col("pos"))
    fp = F.col("__n") - (F.col("cum_neg") - F.col("neg"))
    step = F.sum(F.try_divide(F.col("pos").cast("double"), F.col("__p")) * F.try_divide(tp.cast("double"), tp + fp))
    both = (F.col("__p") > 0) & (F.col("__n") > 0)
    return s.groupBy(*keys, "__p", "__n").agg(pairs.alias("__pairs"), step.alias("__step")).select(
        *keys,
        F.when(both, F.try_divide(F.col("__pairs"), F.col("__p") * F.col("__n"))).alias("auc_roc"),
        F.when(both, F.col("__step")).alias("pr_auc"),
    )


def confusion(y: Column, hit: Column) -> dict[str, Column]:
    return {
        "tp": F.count_if((y == 1) & hit),
        "fp": F.count_if((y == 0) & hit),
        "fn": F.count_if((y == 1) & ~hit),
    }


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, 0 where undefined."""
    zero = F.lit(0.0)
    precision = F.coalesce(ratio(tp, tp + fp), zero)
    recall = F.coalesce(ratio(tp, tp + fn), zero)
    f1 = F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), zero)
    return precision, recall, f1


def threshold_metrics(df: DataFrame, keys: list[str], y: str, score: str, threshold: Column) -> DataFrame:
    """n, base rate, precision, recall, F1 and lift at a threshold (a literal or a column)."""
    hit = F.col(score) >= threshold
    cells = confusion(F.col(y), hit)
    out = df.groupBy(*keys).agg(
        F.count(y).alias("n_samples"),
        F.sum(F.col(y).cast("long")).alias("n_positive"),
        *[c.alias(f"__{k}") for k, c in cells.items()],
    )
    precision, recall, f1 = prf(F.col("__tp"), F.col("__fp"), F.col("__fn"))
    base = ratio("n_positive", "n_samples")
    return out.select(
        *keys, "n_samples", "n_positive", base.alias("base_rate"), precision.alias("precision"),
        recall.alias("recall"), f1.alias("f1"), ratio(precision, base).alias("lift"),
    )


def best_f1_threshold(df: DataFrame, keys: list[str], y: str, score: str, default: float | None = None) -> DataFrame:
    """Threshold of the scan 0.05..0.94 with the best F1, the lowest one on a tie.

    Each row is counted once, in the highest threshold it reaches; what a threshold catches is
    the count from there up. Rows are not multiplied by the grid. `default` replaces the result
    when no threshold has a positive F1.
    """
    grid = lambda i: i * F.lit(0.01) + F.lit(0.05)
    p = F.col(score)
    i = F.floor((p - 0.05) / 0.01)
    i = F.when(p < grid(i), i - 1).when(p >= grid(i + 1), i + 1).otherwise(i)
    i = F.greatest(F.least(i, F.lit(THRESHOLDS - 1)), F.lit(-1)).cast("int")
    hist = df.groupBy(*keys, i.alias("i")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"), F.count(y).alias("n")
    )
    spine = df.select(*keys).distinct().withColumn("i", F.explode(F.sequence(F.lit(-1), F.lit(THRESHOLDS - 1))))
    # at most 91 rows per key from here on
    full = spine.join(hist, [*keys, "i"], "left").fillna(0, ["pos", "n"])
    up = Window.partitionBy(*keys).orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    cum = full.select(
        *keys, "i", F.sum("pos").over(up).alias("tp"), F.sum("n").over(up).alias("hits"),
        F.sum("pos").over(every).alias("p"),
    )
    f1 = F.coalesce(ratio(2 * F.col("tp"), F.col("hits") + F.col("p")), F.lit(0.0))
    cum = cum.filter(F.col("i") >= 0).select(*keys, grid(F.col("i")).alias("threshold"), f1.alias("f1"))
    best = cum.groupBy(*keys).agg(F.max(F.struct("f1", (-F.col("threshold")).alias("neg"))).alias("b"))
    thr = -F.col("b.neg")
    if default is not None:
        thr = F.when(F.col("b.f1") > 0, thr).otherwise(F.lit(default))
    return best.select(*keys, thr.alias("threshold"), F.col("b.f1").alias("f1"))


def per_class(df: DataFrame, classes: dict[int, str], label: str) -> DataFrame:
    """One row per class: its score and whether the row belongs to it."""
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("cls_id"), F.col(s).alias("score"), (F.col(label) == c).cast("int").alias("is_cls"))
            for c, s in classes.items()
        ]
    )
    return df.withColumn("__e", F.explode(rows)).select("*", "__e.*").drop("__e")


def auc_ovr_macro(
    df: DataFrame, keys: list[str], classes: dict[int, str], label: str, bounded: bool = False
) -> DataFrame:
    """Unweighted mean of one-against-rest AUCs; null when a class is absent."""
    long = per_class(df, classes, label).select(*keys, "cls_id", "score", "is_cls")
    auc = ranking_metrics(long, [*keys, "cls_id"], "is_cls", "score", bounded)
    mean = F.when(F.count("auc_roc") == len(classes), F.avg("auc_roc"))
    return auc.groupBy(*keys).agg(mean.alias("auc_ovr"))


def f1_macro_accuracy(df: DataFrame, keys: list[str], label: str, pred: str, classes: list[int]) -> DataFrame:
    """Unweighted mean F1 over the classes that occur as label or prediction, and accuracy."""
    y, h = F.col(label), F.col(pred)
    cells = []
    for c in classes:
        cells += [
            F.count_if((y == c) & (h == c)).alias(f"__tp{c}"),
            F.count_if((y != c) & (h == c)).alias(f"__fp{c}"),
            F.count_if((y == c) & (h != c)).alias(f"__fn{c}"),
        ]
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((y == h).cast("double")).alias("accuracy"), *cells)
    f1s, seen = [], []
    for c in classes:
        tp, fp, fn = (F.col(f"__{k}{c}") for k in ("tp", "fp", "fn"))
        f1s.append(prf(tp, fp, fn)[2])
        seen.append((tp + fp + fn > 0).cast("int"))
    total = reduce(lambda a, b: a + b, f1s)
    return out.select(*keys, "n", ratio(total, reduce(lambda a, b: a + b, seen)).alias("f1_macro"), "accuracy")


def regression_metrics(df: DataFrame, keys: list[str], y: str, yhat: str, signal: float = 0.05) -> DataFrame:
    err = F.col(y) - F.col(yhat)
    sig, act = F.col(yhat) > signal, F.col(y) > signal
    return df.groupBy(*keys).agg(
        F.count(y).alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        pearson(y, yhat).alias("pearson_r"),
        F.count_if(sig).alias("n_signals"),
        F.avg((sig == act).cast("double")).alias("signal_acc"),
    )


def pairwise_correlation(df: DataFrame, keys: list[str], cols: list[str], limit: float = 0.90) -> DataFrame:
    """(a, b, r, high) for each pair of columns, all pairs in one aggregation."""
    pairs = list(combinations(cols, 2))
    wide = df.groupBy(*keys).agg(*[pearson(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs]
    )
    out = wide.select(*keys, F.explode(rows).alias("e")).select(*keys, "e.*")
    return out.withColumn("high", F.coalesce(F.abs("r") > limit, F.lit(False)).cast("int"))


def overfit_gap(df: DataFrame, keys: list[str], split: str = "split", metric: str = "auc_roc", warn: float = 0.10, bad: float = 0.15) -> DataFrame:
    """Training minus validation metric with a warning level."""
    at = lambda s: F.max(F.when(F.col(split) == s, F.col(metric)))
    out = df.groupBy(*keys).agg(at("train").alias("train_auc"), at("val").alias("val_auc"), at("test").alias("test_auc"))
    gap = F.col("train_auc") - F.col("val_auc")
    level = F.when(gap > bad, "overfit").when(gap > warn, "warning").when(gap.isNotNull(), "ok")
    return out.withColumns({"gap": gap, "level": level})


def delta_vs_best(df: DataFrame, keys: list[str], model: str, metric: str, ensemble, lower_is_better: bool = False) -> DataFrame:
    """Ensemble metric against the best single model; positive means the ensemble is better.

    An ensemble without the metric counts as 0, as does a set of models without one.
    """
    mine = F.max(F.when(F.col(model) == ensemble, F.col(metric)))
    others = F.when(F.col(model) != ensemble, F.col(metric))
    best = F.min(others) if lower_is_better else F.max(others)
    out = df.groupBy(*keys).agg(
        F.coalesce(mine, F.lit(0.0)).alias("ensemble"), F.coalesce(best, F.lit(0.0)).alias("best_single")
    )
    delta = F.col("best_single") - F.col("ensemble") if lower_is_better else F.col("ensemble") - F.col("best_single")
    return out.withColumn("delta", delta)
