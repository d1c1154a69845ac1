"""Exact top-k inner products over vectors sorted by length, pruned by Cauchy-Schwarz residual bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Vectors of a packed block, and of a block of queries.
BLOCK = 4096
QUERIES = 1024
#: Candidates that are bounded and scored at a time within a block.
STRIP = 512
LIMIT = 2**63 - 1


def _matrix(vectors: list) -> np.ndarray:
    """Vectors as rows of whole numbers in doubles, short ones filled up with zeros."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, pairwise by row; beyond 2**53 with Python integers, at most the range of a long."""
    d = min(q.shape[1], c.shape[1])
    q, c = q[:, :d], c[:, :d]
    rough = np.einsum("ij,ij->i", np.abs(q), np.abs(c))
    out = np.einsum("ij,ij->i", q, c)
    if not len(rough) or rough.max() < 2.0**53:
        return out.astype(np.int64)
    return np.array(
        [max(-LIMIT - 1, min(LIMIT, sum(int(a) * int(b) for a, b in zip(x, y)))) for x, y in zip(q, c)], np.int64)


def top_in_block(q_id, q, floor, c_id, c, rotation, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of one block for each query that can reach its floor.

    The block is in descending length. Strip by strip, a query stays while its length times the
    strip's first length reaches the k-th score known so far; the first rotated coordinates give a partial
    product, and the lengths of the rest bound what they leave out. Queries with a pair whose bound
    reaches the k-th score are multiplied out with the strip, in whole numbers.
    """
    width = max(q.shape[1], c.shape[1], len(rotation))
    pad = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
    turn = np.eye(width)
    turn[:len(rotation), :len(rotation)] = rotation
    q, c = pad(q), pad(c)
    # bounds are made in doubles on scaled vectors; the slack covers their rounding
    top_q, top_c = np.abs(q).max(initial=1.0), np.abs(c).max(initial=1.0)
    scale = max(top_q, top_c)
    tq, tc = (q / scale) @ turn, (c / scale) @ turn
    unit, head, slack = scale * scale, max(1, width // 4), 1e-9 * width
    plain = top_q * top_c * width < 2.0**53  # products and sums of doubles are then exact
    lq, lc = np.linalg.norm(tq, axis=1), np.linalg.norm(tc, axis=1)
    rq, rc = np.linalg.norm(tq[:, head:], axis=1), np.linalg.norm(tc[:, head:], axis=1)
    order = np.argsort(-lc, kind="stable")
    floor = floor.copy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(c), STRIP):
        strip = order[at:at + STRIP]
        need = floor.astype(np.float64) / unit - slack
        live = np.flatnonzero(lq * lc[strip[0]] >= need)
        if not len(live):
            break
        bound = tq[live, :head] @ tc[strip, :head].T + rq[live, None] * rc[strip]
        near = (bound >= need[live, None]) & (q_id[live, None] != c_id[strip])
        some = near.any(axis=1)
        live, near = live[some], near[some]
        if plain:
            score = (q[live] @ c[strip].T).astype(np.int64)
        else:
            score = np.zeros(near.shape, np.int64)
            a, b = np.nonzero(near)
            for i in range(0, len(a), 65536):
                x, y = a[i:i + 65536], b[i:i + 65536]
                score[x, y] = exact(q[live[x]], c[strip[y]])
        near &= score >= floor[live, None]
        if len(strip) >= k:
            kth = np.partition(np.where(near, score, -LIMIT - 1), len(strip) - k, axis=1)[:, len(strip) - k]
            floor[live] = np.maximum(floor[live], kth)
            near &= score >= floor[live, None]
        a, b = np.nonzero(near)
        found.append((live[a], strip[b], score[a, b]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    a, b, score = (np.concatenate(x) for x in zip(*found))
    by = np.lexsort((c_id[b], -score, a))
    a, b, score = a[by], b[by], score[by]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    keep = rank < k
    return q_id[a[keep]], c_id[b[keep]], score[keep]


def _gram(vectors: DataFrame) -> np.ndarray:
    """Rotation onto the right singular vectors of all candidates: one d x d matrix per partition is summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((0, 0))
        for batch in batches:
            m = _matrix(batch["v"].to_pylist())
            m = m / np.maximum(1.0, np.abs(m).max(axis=1, initial=0))[:, None]
            g = m.T @ m
            if len(g) > len(total):
                total = np.pad(total, (0, len(g) - len(total)))
            total[:len(g), :len(g)] += g
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "x"])

    rows = vectors.select("v").mapInArrow(run, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    d = int(rows[["i", "j"]].max().max()) + 1 if len(rows) else 1
    g = np.zeros((d, d))
    g[rows["i"], rows["j"]] = rows["x"]
    return np.linalg.eigh((g + g.T) / 2)[1][:, ::-1]


def _packed(rows: DataFrame, by: str, size: int, number: str) -> DataFrame:
    """Vectors in range partitions of `by` descending, packed into blocks: (part, seq, n, top, low, ids, floor, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held = TaskContext.get().partitionId(), 0, []

        def close(rows):
            m = _matrix([r["v"] for r in rows])
            return pa.RecordBatch.from_pylist([{
                number: part << 32 | seq, "n": len(rows), "top": rows[0][by], "low": rows[-1][by],
                "ids": np.array([r["vec_id"] for r in rows], np.int64).tobytes(),
                "floors": np.array([r["floor"] for r in rows], np.int64).tobytes(), "v": m.tobytes()}],
                schema=pa.schema([(number, pa.int64()), ("n", pa.int32()), ("top", pa.float64()), ("low", pa.float64()),
                                  ("ids", pa.binary()), ("floors", pa.binary()), ("v", pa.binary())]))

        for batch in batches:
            held += batch.to_pylist()
            while len(held) >= size:
                yield close(held[:size])
                held, seq = held[size:], seq + 1
        if held:
            yield close(held)

    parts = max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // size))
    ordered = rows.repartitionByRange(parts, F.desc(by)).sortWithinPartitions(F.desc(by), "vec_id")
    return cut(ordered.mapInArrow(run, f"{number} long, n int, top double, low double, ids binary, floors binary, v binary"), "blocks")


def _unpack(block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = block["n"]
    return np.frombuffer(block["ids"], np.int64), np.frombuffer(block["floors"], np.int64), np.frombuffer(block["v"]).reshape(n, -1)


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id", embedding: str = "embedding",
    block: int = BLOCK, query_block: int = QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with all other vectors, ties to
    the smaller id, all candidates if there are fewer. A component x counts as floor(scale * x).

    Candidates are sorted by length and packed into blocks. Every query first meets the longest block,
    which gives it a floor: its k-th score there. Queries are then packed by floor over length, the length
    a candidate must have, and a query block only meets the blocks that are long enough for
    one of its queries. Pairs of blocks are joined by the block's number; within a pair see `top_in_block`.
    Broadcast is the longest block only; the driver holds one row per block.

    Vectors that are null or hold null or non-finite components take no part, neither do rows without
    id. Shorter vectors count as filled up with zeros. Rows that repeat an id and vector are one;
    of rows that repeat an id all are candidates of others. Scores beyond a long stop at its
    range. Empty tables give no rows.
    """
    import math

    spark = vectors.sparkSession

    def valid(df: DataFrame) -> DataFrame:
        e = F.col(embedding)
        inf = F.lit(math.inf)
        fine = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < inf))
        whole = F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("double"))
        big = F.transform(e, lambda x: x.cast("double") * scale)
        v = F.when(F.forall(big, lambda x: F.abs(x) < 2.0**52), whole).otherwise(big)  # large doubles are whole
        out = df.filter(F.col(vec_id).isNotNull() & fine).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).distinct()
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        return out.withColumn("length", length).withColumn("floor", F.lit(-LIMIT - 1).cast("long"))

    candidates = cut(valid(vectors), "vectors")
    asked = cut(valid(queries), "queries")
    rotation = spark.sparkContext.broadcast(_gram(candidates))
    blocks = _packed(candidates, "length", block, "c_block")
    index = sorted((r["c_block"], r["top"]) for r in blocks.select("c_block", "top").collect())
    schema = "query_id long, vec_id long, score long"
    if not index:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    longest = spark.sparkContext.broadcast(blocks.filter(F.col("c_block") == index[0][0]).first().asDict())

    def meet_longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c_id, _, c = _unpack(longest.value)
        for batch in batches:
            for at in range(0, batch.num_rows, query_block):
                part = batch.slice(at, query_block)
                ids = part["vec_id"].to_numpy()
                q, s, x = top_in_block(ids, _matrix(part["v"].to_pylist()), part["floor"].to_numpy(), c_id, c, rotation.value, k)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(s, pa.int64()), pa.array(x, pa.int64())], names=["query_id", "vec_id", "score"])

    near = cut(asked.mapInArrow(meet_longest, schema), "longest")
    floors = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    floored = asked.drop("floor").join(floors, asked["vec_id"] == floors["query_id"], "left").select(
        "vec_id", "v", "length", F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(-LIMIT - 1)).cast("long").alias("floor"))
    # the length that a candidate needs; queries without a floor or of length zero need none
    wants = F.when((F.col("floor") > 0) & (F.col("length") > 0), F.col("floor") / F.col("length")).otherwise(F.lit(0.0))
    packed = _packed(floored.withColumn("wants", wants), "wants", query_block, "q_block")

    # blocks 1, 2, ... whose longest vector reaches what the least demanding query wants
    falling = -np.array([t for _, t in index]) * (1 + 1e-9)
    upto = [(r["q_block"], int(np.searchsorted(falling, -r["low"], "right")) - 1) for r in packed.select("q_block", "low").collect()]
    numbers = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(index)], "at int, c_block long")
    spans = spark.createDataFrame([x for x in upto if x[1] > 0], "q_block long, upto int")
    pairs = spans.select("q_block", F.explode(F.sequence(F.lit(1), "upto")).alias("at")).join(F.broadcast(numbers), "at").select("q_block", "c_block")
    q_side = packed.select("q_block", F.struct("n", "ids", "floors", "v").alias("q"))
    c_side = blocks.select("c_block", F.struct("n", "ids", "floors", "v").alias("c"))
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")) * 4, len(index)))
    joined = pairs.join(q_side, "q_block").repartition(tasks, "c_block").join(c_side, "c_block").select("q", "c")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                q_id, floor, q = _unpack(row["q"])
                c_id, _, c = _unpack(row["c"])
                a, b, s = top_in_block(q_id, q, floor, c_id, c, rotation.value, k)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"])

    found = near.unionByName(joined.mapInArrow(meet, schema))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
