"""File sinks and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder the cluster names in spark.checkpoint.dir.

    Where that is unset, the folder is placed below the session's warehouse, which all executors
    reach as well. What a session has made is removed when its Python process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


@atexit.register
def clear() -> None:
    """Remove the stage tables of this process."""
    for path, spark in list(_made.items()):
        with contextlib.suppress(Exception):  # the session may have been stopped before
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        _made.pop(path)


def stage(df: DataFrame, name: str = "stage", codec: str = "snappy") -> tuple[DataFrame, str]:
    """A table like that of `cut`, and its path, for callers that release it themselves."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, path: str) -> None:
    """Remove a stage table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _made.pop(path, None)


def cut(df: DataFrame, name: str = "stage", codec: str = "snappy") -> DataFrame:
    """Materialise a stage as a table in the shared folder, so later plans read it instead of
    recomputing it; survives the loss of executors."""
    return stage(df, name, codec)[0]


def write_csv(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """Headed CSV files, one folder per value of `by`."""
    df.write.partitionBy(*by).csv(path, header=True)


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    df.write.partitionBy(*by).parquet(path)


def write_documents(df: DataFrame, path: str, digits: int = 4) -> None:
    """One JSON document per row, doubles rounded."""
    cols = [F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.json(path)


def unpivoted_scores(df: DataFrame, models: list[str], keep: list[str]) -> DataFrame:
    """One row per row and model: the columns `keep`, model and p."""
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("p")) for m in models])
    return df.select(*keep, F.explode(each).alias("m")).select(*keep, "m.*")


def write_predictions(df: DataFrame, path: str) -> None:
    """Add scores of models to a store partitioned by (tag, model, split). Rows are dealt out by partition and by a hash, so
    that a large tag has several files and a small one few."""
    spread = df.repartition("tag", "model", "split", F.pmod(F.xxhash64("d"), F.lit(8)))
    spread.write.mode("append").partitionBy("tag", "model", "split").parquet(path)
