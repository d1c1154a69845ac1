"""Tables behind the reports and the dashboard export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nullsafe import pearson, rounded
from ..functions.scalars import feature_group


def split_stats(df: DataFrame, keys: list[str], label: str = "target_binary") -> DataFrame:
    return df.groupBy(*keys, "split").agg(
        F.count(label).alias("n"), F.sum(label).alias("positives"), rounded(F.avg(label)).alias("base_rate")
    )


def class_shares(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Counts and shares per class; the window runs over class counts, not rows."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("pct", rounded(share))


def sorted_results(df: DataFrame) -> DataFrame:
    """Tags in order, best Sharpe first, undefined ones last."""
    return df.orderBy(F.col("tag").asc(), F.col("sharpe").desc_nulls_last())


def top_features(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k features with the highest gain per key, labelled by source.

    The rank filter is also applied before the shuffle, so a task hands on at most k rows per key.
    """
    w = Window.partitionBy(*keys).orderBy(F.col("gain").desc(), "feature")
    ranked = df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.withColumn("grp", feature_group("feature"))


def best_by(df: DataFrame, keys: list[str], choice: str, metric: str) -> DataFrame:
    """The choice with the highest metric per key; the lowest choice wins a tie."""
    best = F.max_by(F.struct(choice, metric), F.struct(F.col(metric), -F.col(choice))).alias("b")
    return df.filter(F.col(metric).isNotNull()).groupBy(*keys).agg(best).select(*keys, "b.*")


def with_full(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows of all splits once more under the name full."""
    return df.withColumn(split, F.lit("full")).unionByName(df)


def report_table(stats: DataFrame, ranking: DataFrame, trading: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (tag, model): test split size and base rate, metrics by split, backtest, flags."""
    at = lambda s, c: F.max(F.when(F.col("split") == s, F.col(c)))
    auc = ranking.groupBy(*keys, "model").agg(
        *[at(s, "auc_roc").alias(f"{s}_auc") for s in ("train", "val", "test")], at("test", "pr_auc").alias("test_pr_auc")
    )
    data = stats.groupBy(*keys).agg(
        at("test", "n").alias("n_test_rows"), at("test", "positives").alias("test_positives"), at("test", "base_rate").alias("test_base_rate")
    )
    gap = F.col("train_auc") - F.col("val_auc")
    issue = F.when(F.col("test_positives") == 0, "no positives in test").when(gap > 0.15, "overfit gap")
    out = auc.join(data, keys).join(trading.select(*keys, "model", "sharpe", "max_drawdown", "win_rate"), [*keys, "model"], "left")
    return out.withColumn("issue", issue)


def hurdle_comparison(df: DataFrame, keys: list[str], theta: float) -> DataFrame:
    """Correlation with the target of the single, half, full and leg models per key.

    Legs are judged on their own side only and need five rows.
    """
    up, down = F.col("r") > theta, F.col("r") < -theta
    half = F.col("p_up") * F.col("m_up")
    full = half - F.col("p_down") * F.col("m_down")
    legs = lambda c, y, x: F.when(F.count_if(c) >= 5, pearson(F.when(c, y), F.when(c, x)))
    return df.groupBy(*keys).agg(
        pearson("r", "single").alias("single_r"),
        pearson(F.col("r"), half).alias("half_r"),
        pearson(F.col("r"), full).alias("full_r"),
        legs(up, F.col("r"), F.col("m_up")).alias("stage2a_r"),
        legs(down, -F.col("r"), F.col("m_down")).alias("stage2b_r"),
        F.count_if(up).alias("n_pos_test"),
        F.count_if(down).alias("n_neg_test"),
    )
