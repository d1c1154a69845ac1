"""Merkle manifest of a dataset: a hash tree per group of rows, one tree over the groups, and a proof for every row.

Proofs come by pointer jumping. A node starts with a pointer to its parent and a segment that holds its siblings; a
self-join on the pointer adds the segment of the node it points to and takes over that node's pointer, so the
distance doubles each time until every leaf points at the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: The name of the tree over the groups; names of groups start with a letter.
TOP = ""
SEGMENT = "array<struct<left:binary,right:binary>>"


def encoded(c: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(cols: list[Column]) -> Column:
    """The digest of a row: SHA-256 (lowercase hex) of its encoded columns."""
    return F.sha2(F.concat(*[encoded(c) for c in cols]).cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings on its way lead to."""
    step = lambda acc, s: F.sha2(F.concat(F.lower(F.hex(s["left"])), acc, F.lower(F.hex(s["right"]))).cast("binary"), 256)
    return F.aggregate(proof, leaf, step)


def digest_of(proof: Column) -> Column:
    """SHA-256 of a proof's siblings as hex text, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.lower(F.hex(F.concat(s["left"], s["right"])))), "").cast("binary"), 256)


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds pos (from 0 within `tree`, by `order`) and n, the rows of the tree.

    Rows are laid out by range, so a tree with a third of all rows lies in many partitions; only one count per
    tree and partition meets in a window.
    """
    laid = df.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id())
    laid = cut(laid.withColumn("part", F.shiftright("at", 33)), "laid")
    counts = laid.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("m"))
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("m").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("m").over(whole).alias("n"))
    return laid.join(counts, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def grow(nodes: DataFrame, fanout: int) -> tuple[DataFrame, list[DataFrame], int]:
    """Build the trees of `nodes` (tree, pos, n, hash) level by level.

    Returns the node that remains of each tree (tree, level, hash), the runs of siblings of every level (tree, level, up,
    kids) as written tables, and the height of the highest tree. A level has a `fanout`-th of the rows of the one below.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    height, runs = 0, []
    tops = [nodes.filter("n = 1").select("tree", F.lit(0).alias("level"), "hash")]
    while most > 1:
        kid = F.struct("pos", F.unhex("hash").alias("hash"))
        run = nodes.filter("n > 1").groupBy("tree", F.expr(f"pos div {fanout}").alias("up"), "n").agg(F.sort_array(F.collect_list(kid)).alias("kids"))
        run = cut(run, "runs")
        runs.append(run.select("tree", F.lit(height).alias("level"), "up", "kids"))
        joined = F.array_join(F.transform("kids", lambda k: F.lower(F.hex(k["hash"]))), "")
        nodes = run.select("tree", F.col("up").alias("pos"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), F.sha2(joined.cast("binary"), 256).alias("hash"))
        most, height = -(-most // fanout), height + 1
        tops.append(nodes.filter("n = 1").select("tree", F.lit(height).alias("level"), "hash"))
    last = tops[0]
    for t in tops[1:]:
        last = last.unionByName(t)
    return last, runs, height


def steps(run: DataFrame) -> DataFrame:
    """The nodes of a level with a pointer to their parent and a segment of one step: the siblings on either side."""
    digests = lambda a, b: F.aggregate(F.slice("kids", a, b), F.lit(b""), lambda acc, k: F.concat(acc, k["hash"]))
    kids = run.select("*", F.posexplode("kids").alias("j", "kid"))
    segment = F.array(F.struct(digests(F.lit(1), F.col("j")).alias("left"), digests(F.col("j") + 2, F.size("kids")).alias("right")))
    return kids.select(
        "tree", "level", F.col("kid.pos").alias("pos"), F.col("tree").alias("to_tree"), (F.col("level") + 1).alias("to_level"),
        F.col("up").alias("to_pos"), segment.cast(SEGMENT).alias("segment"))


def jump(table: DataFrame, distance: int) -> DataFrame:
    """Double the distance of every pointer until all leaves point past the root.

    Before a round with pointers of `step` levels, leaves look at nodes at multiples of `step` only, so other nodes of the
    groups' trees are left behind; what is looked up has a small part of the rows of the leaves.
    """
    step = 1
    while step < distance:
        top = F.col("tree") == TOP
        carried = table.filter(top | (F.col("level") % (2 * step) == 0))
        ahead = cut(table.filter(top | ((F.col("level") % step == 0) & (F.col("level") >= step))), "ahead").select(
            F.col("tree").alias("to_tree"), F.col("level").alias("to_level"), F.col("pos").alias("to_pos"),
            F.struct("to_tree", "to_level", "to_pos").alias("next"), F.col("segment").alias("more"))
        there = carried.filter("to_tree is null")
        on = carried.filter("to_tree is not null").join(ahead, ["to_tree", "to_level", "to_pos"]).select(
            "tree", "level", "pos", "next.*", F.concat("segment", "more").alias("segment"))
        table, step = cut(there.unionByName(on), "jumped", "zstd"), 2 * step
    return table


def manifest(
    docs: DataFrame, leaf: Column, keep: list[str], group: str = "source", order: str = "doc_id", fanout: int = 3, carry: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of `docs`: row (the columns `keep`), the columns of `carry`, leaf, subroot, root and proof.

    Rows of a group ascend by `order` (nulls first; then by leaf). While a tree has several nodes, every `fanout` consecutive ones become the digest
    of their digests; a last run may be shorter, even a single node. What remains of a group is its subroot; subroots,
    ordered by group (null first, then bytewise), make the root in the same way. `proof` holds, level by level up to the
    root, the digests left and right of the way (binary, concatenated).

    Null groups are a group; repeated rows have equal leaves and follow each other, each with its own proof. One row
    only: no siblings, its leaf is the root. An empty table gives no rows. Texts are read once; further columns and their
    names do not matter, as only `keep`, packed into `row`, is carried.

    A group may hold any part of the rows. Only the root and the largest number of rows of a group reach the driver.
    """
    extra = {f"carry_{i}": c for i, c in enumerate((carry or {}).values())}
    name = F.when(F.col(f"`{group}`").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(f"`{group}`").cast("string")))
    leaves = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), name.alias("tree"), F.col(f"`{order}`").alias("by"), leaf.alias("hash"),
        *[c.alias(k) for k, c in extra.items()])
    leaves = cut(numbered(cut(leaves, "leaves"), ["by", "hash"]), "numbered")
    tops, runs, height = grow(leaves.select("tree", "pos", "n", "hash"), fanout)
    # the subroots are the leaves of the tree above
    tops = cut(numbered(tops.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), F.col("level").alias("at_level"), "hash"), ["name"]), "subroots")
    root, upper, above = grow(tops.select("tree", "pos", "n", "hash"), fanout)
    root = cut(root, "root")
    found = root.first()
    table = None
    for k, run in enumerate([*runs, *upper]):
        part = steps(run)
        if k == len(runs):  # a subroot goes by the name of its own tree
            at = tops.select(F.col("name").alias("own"), "at_level", "pos")
            part = part.join(at, "pos").select(F.col("own").alias("tree"), F.col("at_level").alias("level"), F.lit(0).cast("long").alias("pos"), "to_tree", "to_level", "to_pos", "segment")
        table = part if table is None else table.unionByName(part)
    # nodes without a parent: the root
    alone = tops.filter("n = 1").select(F.col("name").alias("tree"), F.col("at_level").alias("level"))
    alone = alone.unionByName(root.filter("level > 0").select("tree", "level"))
    alone = alone.select("tree", "level", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("to_tree"), F.lit(None).cast("int").alias("to_level"),
                         F.lit(None).cast("long").alias("to_pos"), F.array().cast(SEGMENT).alias("segment"))
    table = cut(alone if table is None else table.unionByName(alone), "steps", "zstd")
    proofs = jump(table, height + above).filter((F.col("level") == 0) & (F.col("tree") != TOP)).select("tree", "pos", F.col("segment").alias("proof"))
    subroots = tops.select(F.col("name").alias("tree"), F.col("hash").alias("subroot"))
    out = leaves.join(proofs, ["tree", "pos"]).join(subroots, "tree")
    return out.select("row", *[F.col(k).alias(c) for k, c in zip(extra, carry or {})], F.col("hash").alias("leaf"), "subroot",
                      F.lit(found["hash"] if found else None).cast("string").alias("root"), "proof")
