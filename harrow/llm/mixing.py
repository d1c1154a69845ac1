"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Words of a block, and how many blocks there may be; blocks grow beyond that.
BLOCK_WORDS = 1_000_000
MAX_BLOCKS = 100_000
PARTS = 1 << 20


def words(text: Column) -> Column:
    """Number of runs of characters other than blank and tab to carriage return; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...], share: float, cap: float) -> dict[str | None, float]:
    """Words wanted per source: `share` of all sizes by weight, at most `cap` times a source's size,
    the excess reshared by weight among the others until none is above. Weights repeat over the
    sources in code point order, null last."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, open_ = share * sum(sizes.values()), {}, list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = float(cap * sizes[s])
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard, shape (shards, sources).

    The shard range is halved again and again; the left half draws its share of the blocks without
    replacement, which is multivariate hypergeometric in the source quotas. Every node has its
    own generator, so a shard can be drawn without its siblings.
    """
    out = np.zeros((shards, len(quotas)), np.int64)
    stack = [(0, shards, quotas.astype(np.int64))]
    while stack:
        a, b, have = stack.pop()
        if b - a == 1:
            out[a] = have
            continue
        mid = (a + b) // 2
        n = int(have.sum()) * (mid - a) // (b - a)
        rng = np.random.default_rng([seed, a, b])
        left = rng.multivariate_hypergeometric(have, n, method="marginals") if len(have) else have
        stack += [(a, mid, left), (mid, b, have - left)]
    return out


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """Take whole documents of the block that the target cuts while they fit. Several orders are
    tried, large ones first and random ones; the one that comes nearest holds."""
    pdf = pdf.sort_values("key", kind="stable")
    room, size = float(pdf["room"].iloc[0]), pdf["size"].to_numpy()
    rng, best, least = np.random.default_rng(len(pdf)), np.zeros(len(pdf), np.int64), room
    for turn in range(16):
        order = rng.permutation(len(size)) if turn else np.argsort(-size, kind="stable")
        take, left = np.zeros(len(size), np.int64), room
        for i in order:
            if 0 < size[i] <= left:
                take[i], left = 1, left - size[i]
        rest = np.flatnonzero((take == 0) & (size > 0))
        if len(rest) and abs(left - size[rest].min()) < left:  # one more may come nearer
            i = rest[np.argmin(size[rest])]
            take[i], left = 1, abs(left - size[i])
        if left < least:
            best, least = take, left
    return pd.DataFrame({"key": pdf["key"], "extra": best})


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
    weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, shards: int = 64,
    seed: int = 1, block_words: int = BLOCK_WORDS, max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """One row per document: `row` (the input), size, source_size, target, passes (how often it is
    taken), taken (words), and `shards`, the output shard of each pass.

    Documents fall into blocks of their source by a hash of id, text and source, about
    `block_words` words each (larger if there would be more than `max_blocks`). A source with
    target t and size n is taken floor(t / n) times whole; of one more pass, blocks in a random
    order up to the rest of the target, and of the block that it cuts the documents that fit. The
    splitting tree hands every shard its number of blocks per source; shards draw disjoint runs of
    the permuted blocks. `expand` makes the mix itself, shuffled within its shards.

    The driver holds one row per source and per block, at most `max_blocks` plus the sources.
    A hot source only has more blocks. Empty and null texts have size 0 and are in no pass unless
    their whole block is; null sources are one source, ordered last. Repeated rows are taken
    alike. An empty table gives no rows. The result depends on rows and seed.
    """
    spark = docs.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    key = F.xxhash64(F.col(doc_id), F.col(text), F.col(source), F.lit(seed))
    base = docs.select(row.alias("row"), F.col(text).alias("body"), F.col(source).alias("src"), key.alias("key"))
    base = base.withColumn("u", F.pmod("key", F.lit(PARTS)).cast("int"))
    slim = cut(base.select("src", "key", "u", words(F.col("body")).alias("size")), "sizes")
    sizes = {r["src"]: r["size"] for r in slim.groupBy("src").agg(F.sum("size").alias("size")).collect()}
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    want, unit = targets(sizes, weights, share, cap), max(block_words, sum(sizes.values()) // max_blocks)
    about = spark.createDataFrame(
        [(s, sizes[s], want[s], sid, max(1, sizes[s] // unit)) for sid, s in enumerate(order)],
        "src string, source_size long, target double, sid int, blocks int")

    def place(df: DataFrame) -> DataFrame:
        # `about` has one row per source, which the driver holds already
        block = F.floor(F.col("u").cast("long") * F.col("blocks") / PARTS).cast("int")
        named = df.withColumnRenamed("src", "own")
        return named.join(F.broadcast(about), named["own"].eqNullSafe(about["src"])).withColumn("block", block)

    placed = place(slim)
    held = placed.groupBy("sid", "block").agg(F.sum("size").alias("n")).toPandas().sort_values(["sid", "block"])
    dealt, cuts = [], []
    copies = np.zeros(len(order), np.int64)
    for sid, s in enumerate(order):
        mine = held[held["sid"] == sid]
        passes, rest = divmod(want[s], sizes[s]) if sizes[s] else (0, 0.0)
        for turn in range(int(passes) + 1):
            rng = np.random.default_rng([seed, sid, turn])
            ids = mine["block"].to_numpy()[rng.permutation(len(mine))]
            n = mine.set_index("block")["n"].reindex(ids).to_numpy()
            upto = np.cumsum(n)
            whole = len(ids) if turn < passes else int(np.searchsorted(upto, rest, "right"))
            dealt += [(sid, int(b), turn, i + int(copies[sid])) for i, b in enumerate(ids[:whole])]
            if turn >= passes and whole < len(ids) and rest > 0:
                room = rest - (upto[whole - 1] if whole else 0)
                cuts.append((sid, int(ids[whole]), float(room)))
                dealt.append((sid, int(ids[whole]), -1, whole + int(copies[sid])))
                whole += 1
            copies[sid] += whole
    tree = np.cumsum(split_tree(copies, shards, seed), axis=0)
    shard_of = lambda sid, i: int(np.searchsorted(tree[:, sid], i, "right"))
    by_block: dict[tuple[int, int], dict] = {(r.sid, r.block): {"full": [], "part": None} for r in held.itertuples()}
    for sid, b, turn, i in dealt:
        if turn < 0:
            by_block[sid, b]["part"] = shard_of(sid, i)
        else:
            by_block[sid, b]["full"].append(shard_of(sid, i))
    room = {(sid, b): r for sid, b, r in cuts}
    blocks = spark.createDataFrame(
        [(sid, b, x["full"], x["part"], room.get((sid, b))) for (sid, b), x in by_block.items()],
        "sid int, block int, full array<int>, part int, room double")
    out = place(base).join(F.broadcast(blocks), ["sid", "block"])

    # the cut blocks: at most one per source, each of about a block's words
    choice = placed.join(F.broadcast(blocks.filter("room is not null")), ["sid", "block"])
    choice = choice.groupBy("sid", "key", "u", "room").agg(F.sum("size").alias("size"))
    extra = cut(choice.groupBy("sid").applyInPandas(_fill, "key long, extra long"), "cut_blocks").filter("extra > 0")
    in_cut = out.filter("room is not null").join(extra, "key", "left")
    in_cut = in_cut.withColumn("shards", F.when(F.col("extra") == 1, F.array_append("full", F.col("part"))).otherwise(F.col("full")))
    other = out.filter("room is null").withColumn("shards", F.col("full"))
    cols = ["row", "body", "source_size", "target", "shards"]
    return in_cut.select(*cols).unionByName(other.select(*cols)).select(
        "row", words(F.col("body")).alias("size"), "source_size", "target", F.size("shards").alias("passes"),
        (words(F.col("body")) * F.size("shards")).alias("taken"), "shards")


def expand(mixed: DataFrame, seed: int = 1) -> DataFrame:
    """The mix: a row (row, shard, pass) for every time a document is taken, in shard order and
    shuffled within each shard."""
    rows = mixed.select("row", F.posexplode("shards").alias("pass", "shard"))
    key = F.xxhash64("row", "pass", F.lit(seed))
    return rows.repartition("shard", F.pmod(key, F.lit(16))).withColumn("at", key).sortWithinPartitions("shard", "at").drop("at")
