"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.sources.sinks import cut

Query = Callable[[SparkSession, str], DataFrame]

__all__ = ["Query", "bounded_sample", "compose", "cut", "components", "in_fraction", "pack", "portions", "read", "revive"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pack(df: DataFrame) -> DataFrame:
    """All columns as one struct `row`, so that columns an operator adds cannot clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def in_fraction(doc_id: str, modulus: int, rest: int) -> Column:
    """crc32 of the id as text modulo `modulus` equals `rest`; false for a missing id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == rest, F.lit(False))


def compose(maps: list[DataFrame]) -> DataFrame:
    """Chain the (v, m) maps of successive contractions into one map."""
    out = maps[-1]
    for earlier in reversed(maps[:-1]):
        later = out.select(F.col("v").alias("m"), F.col("m").alias("to"))
        out = earlier.join(later, "m", "left").select("v", F.coalesce("to", "m").alias("m"))
    return out


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (v, m) per linked vertex, m the least vertex.

    Each round maps a vertex to the least of itself and its neighbours and contracts the graph by
    that map; vertices that stay are local minima, so their number at least halves. The minimum of
    a neighbourhood is combined before the shuffle, so a hub costs no more than its rows. Rounds
    are written to the shared folder; only the number of remaining edges reaches the driver.
    Null ends are ignored. No edges: no rows.
    """
    maps: list[DataFrame] = []
    edges = edges.select("a", "b").filter("a <> b").distinct()
    while True:
        edges = cut(edges, "edges")
        if maps and edges.isEmpty():
            return compose(maps)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("m")), "contract")
        maps.append(least)
        left = least.select(F.col("v").alias("a"), F.col("m").alias("ma"))
        right = least.select(F.col("v").alias("b"), F.col("m").alias("mb"))
        edges = (
            edges.join(left, "a").join(right, "b").filter("ma <> mb")
            .select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct()
        )


def portions(texts: list[str], size: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `size` characters."""
    begin = n = 0
    for k, text in enumerate(texts):
        n += len(text)
        if n >= size or k == len(texts) - 1:
            yield begin, k + 1
            begin, n = k + 1, 0


def revive(kind: type, state: dict | None):
    """An object from its broadcast attributes; broadcasts carry plain data only."""
    if state is None:
        return None
    out = kind.__new__(kind)
    out.__dict__.update(state)
    return out


def bounded_sample(classes: DataFrame, texts: DataFrame, caps: Callable[[object], int]) -> list[tuple[str, object]]:
    """Sorted (text, class) of at most caps(class) ids of each class, chosen by a hash of the id.

    `classes` has (id, class), `texts` (id, text). Ids are thinned to about twice the cap before they are ranked, and only
    the chosen ids, a bounded number, are joined with the texts; an id's least text stands for it.
    """
    ids = classes.groupBy("id").agg(F.max("class").alias("class"))
    counts = {r["class"]: r["n"] for r in ids.groupBy("class").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    limits = [(c, caps(c), min(1.0, 2 * caps(c) / n)) for c, n in counts.items()]
    about = classes.sparkSession.createDataFrame(limits, T.StructType([classes.schema["class"], T.StructField("cap", T.IntegerType()), T.StructField("share", T.DoubleType())]))
    key = F.xxhash64("id")
    thinned = ids.join(F.broadcast(about), "class").filter(F.pmod(key, F.lit(1 << 30)) < F.col("share") * (1 << 30))
    rank = F.row_number().over(Window.partitionBy("class").orderBy(key, "id"))
    chosen = thinned.withColumn("rank", rank).filter("rank <= cap").select("id", "class")
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "class").agg(F.min("text").alias("text"))
    return sorted((r["text"], r["class"]) for r in found.collect())
