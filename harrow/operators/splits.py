"""Position-based splits, folds, sampling and scaling."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import positions

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TRAIN_SHARE, VAL_SHARE = 0.70, 0.80
#: Shuffled values that a task holds at once.
OUT_VALUES = 1 << 18


def chrono_split(
    df: DataFrame, keys: list[str], d: str, horizon: int | Column, keep_embargo: bool = False
) -> DataFrame:
    """Add rn, n and split: train / val / test by position, `horizon` rows cut at each border.

    Cut rows get a null split and are dropped unless keep_embargo.
    """
    p = positions(df, keys, d, "rn", "n")
    i, n = F.col("rn") - 1, F.col("n")
    val, test = F.floor(n * F.lit(TRAIN_SHARE)), F.floor(n * F.lit(VAL_SHARE))
    split = (
        F.when(i < val - horizon, "train")
        .when((i >= val) & (i < test - horizon), "val")
        .when(i >= test, "test")
    )
    out = p.withColumn("split", split)
    return out if keep_embargo else out.filter(F.col("split").isNotNull())


def chrono_split_plain(df: DataFrame, keys: list[str], d: str) -> DataFrame:
    """70 / 10 / 20 by position without a gap; the validation size is floored on its own."""
    p = positions(df, keys, d, "rn", "n")
    i, n = F.col("rn") - 1, F.col("n")
    val = F.floor(n * F.lit(0.70))
    test = val + F.floor(n * F.lit(0.10))
    return p.withColumn("split", F.when(i < val, "train").when(i < test, "val").otherwise("test"))


def check_minimum(df: DataFrame, keys: list[str], rows: int = 10) -> DataFrame:
    """Keys and splits with fewer rows than a fit needs."""
    return df.groupBy(*keys, "split").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < rows)


def last_rows(df: DataFrame, keys: list[str], d: str, n: int) -> DataFrame:
    """The most recent n rows of each series."""
    p = positions(df, keys, d, "__rn", "__n")
    return p.filter(F.col("__rn") > F.col("__n") - n).drop("__rn", "__n")


def walkforward(df: DataFrame, train_rows: int = 1000, step: int = 130, embargo: int = 0) -> DataFrame:
    """Rows of every walk-forward block, as (block, role) copies of a table with rn and n.

    Test block b holds positions [start + b*step, start + (b+1)*step); its training rows are the
    `train_rows` before it. The blocks a row trains for are an arithmetic range, so membership is
    an explode, not a range join.
    """
    i, n = F.col("rn") - 1, F.col("n")
    start = F.floor(n * F.lit(VAL_SHARE))
    blocks = F.ceil((n - start) / step).cast("long")
    # trained by b iff start+b*step-train_rows <= i < start+b*step-embargo
    first = F.greatest(F.floor((i + embargo - start) / step) + 1, F.lit(0))
    last = F.least(F.floor((i + train_rows - start) / step), blocks - 1)
    trains = F.when(first <= last, F.transform(F.sequence(first, last), lambda b: F.struct(b.alias("block"), F.lit("train").alias("role"))))
    tests = F.when(
        i >= start, F.array(F.struct(F.floor((i - start) / step).alias("block"), F.lit("test").alias("role")))
    )
    empty = F.array().cast("array<struct<block:bigint,role:string>>")
    member = F.concat(F.coalesce(trains, empty), F.coalesce(tests, empty))
    return df.withColumn("__m", F.explode(member)).select("*", "__m.block", "__m.role").drop("__m")


def expanding_folds(df: DataFrame, folds: int = 3) -> DataFrame:
    """Copies of a table with rn and n for each expanding fold: (fold, role)."""
    i, n = F.col("rn") - 1, F.col("n")
    size = F.floor(n / (folds + 1))
    fold = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold")
    out = df.select("*", fold)
    start = n - (folds - F.col("fold")) * size
    role = F.when(i < start, "train").when(i < start + size, "test")
    return out.withColumn("role", role).filter(F.col("role").isNotNull())


def stride(df: DataFrame, keys: list[str], d: str, step: int | Column = 7) -> DataFrame:
    """Every step-th row of each series, starting with the first."""
    p = positions(df, keys, d, "__rn")
    return p.filter((F.col("__rn") - 1) % step == 0).drop("__rn")


def sample_rows(df: DataFrame, keys: list[str], ident: list[str], k: int, seed: int = 42, score: Column | None = None) -> DataFrame:
    """Up to k rows per key in the order of a seeded hash of the row identity, or of `score`."""
    score = F.xxhash64(F.lit(seed), *ident) if score is None else score
    w = Window.partitionBy(*keys).orderBy("__h", *ident)
    ranked = df.withColumn("__h", score).withColumn("__r", F.row_number().over(w))
    # a row_number <= k filter is applied per task before the shuffle as well (group limit)
    return ranked.filter(F.col("__r") <= k).drop("__h", "__r")


def draw_index(b: Column, j: Column, n: Column) -> Column:
    """Position drawn by draw b for slot j out of n: a fixed integer hash, the same in any engine and for arrays of numpy."""
    return draw_key(b, j) % n


def draw_key(b: Column, j: Column) -> Column:
    mixed = ((b * 7919 + j * 104729) % 1000003) * ((b * 31 + j * 17 + 7) % 999983) + b * j
    return mixed % 2147483647


def permuted_arrays(df: DataFrame, keys: list[str], x: str, draws: int) -> DataFrame:
    """One row per key and draw with the array x in a seeded random order.

    Keys hold arrays already (calendar-bounded); the order comes from sorting hashed positions. It depends on the draw and the
    length only, so a task sorts once per length, and its draws of an array are taken from that.
    """
    numbers = np.arange(1, draws + 1, dtype=np.int64)
    kind = df.schema[x].dataType
    schema = T.StructType([*[f for f in df.schema.fields], T.StructField("b", T.LongType()), T.StructField("shuffled", T.ArrayType(kind.elementType))])
    size = max(1, OUT_VALUES // max(1, draws))

    def orders(n: int) -> np.ndarray:
        """Positions by draw, one draw after the other: by hash, then by position."""
        with np.errstate(over="ignore"):
            h = draw_key(numbers[:, None], np.arange(n, dtype=np.int64)[None, :])
        return np.argsort(h, axis=1, kind="stable").ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            low = 0
            lengths = pc.fill_null(pc.list_value_length(batch[x]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lengths)
            while low < batch.num_rows:
                # some rows at a time, as each becomes so many
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + size, "right")))
                part, own = batch.slice(low, high - low), lengths[low:high]
                values = pc.list_flatten(part[x])
                starts = np.cumsum(own) - own
                for n in set(own.tolist()) - set(known):
                    known[n] = orders(n)
                taken = np.concatenate([known[n] + s for n, s in zip(own.tolist(), starts.tolist())])
                offsets = np.concatenate([[0], np.cumsum(np.repeat(own, draws))])
                again = pa.array(np.repeat(np.arange(high - low), draws))
                missing = pc.is_null(part[x]).take(again)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values.take(pa.array(taken, pa.int64())), mask=missing)
                yield pa.RecordBatch.from_arrays([*[part[c].take(again) for c in batch.schema.names], pa.array(np.tile(numbers, high - low)), lists], names=schema.names)
                low = high

    return df.mapInArrow(run, schema)


def minmax_scale(df: DataFrame, keys: list[str], cols: list[str], split: str = "split") -> DataFrame:
    """Scale by the training range of each key; a constant column becomes value - min."""
    train = F.col(split) == "train"
    ends = df.groupBy(*keys).agg(
        *[F.min(F.when(train, F.col(c))).alias(f"__lo_{c}") for c in cols],
        *[F.max(F.when(train, F.col(c))).alias(f"__hi_{c}") for c in cols],
    )
    out = df.join(ends, keys)

    def scaled(c: str) -> Column:
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        width = F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)
        return (F.col(c) - lo) / width

    return out.withColumns({c: scaled(c) for c in cols}).select(*df.columns)


def balanced_weights(df: DataFrame, keys: list[str], label: str, out: str = "weight") -> DataFrame:
    """n / (classes * class count) per row, from a grouped count joined back."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    # one row per class: the window runs over a handful of rows
    share = F.sum("__c").over(w) / (F.count(F.lit(1)).over(w) * F.col("__c"))
    return df.join(counts.select(*keys, label, share.alias(out)), [*keys, label])


def positive_weight(label: str, cap: float = 10.0) -> Column:
    """Negatives per positive as an aggregate, capped; 1 without positives."""
    pos = F.sum(F.col(label).cast("double"))
    neg = F.count(label) - pos
    return F.when(pos == 0, F.lit(1.0)).otherwise(F.least(F.try_divide(neg, pos), F.lit(cap)))
