"""SimHash near-duplicates: fingerprints and a binary-trie self-join within a Hamming budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut

BITS = 64
HALF = 32
SEED = 42
#: Fingerprints of a trie cell; cells grow when there would be more than MAX_CELLS.
CELL = 1 << 12
MAX_CELLS = 4096
#: Node pairs handled at a time within a task.
CHUNK = 1 << 18
MASKS = np.array([0] + [(~0 << (BITS - d)) & (2**BITS - 1) for d in range(1, BITS + 1)], np.uint64)


def fingerprint(text: str | None, size: int = 4) -> int:
    """SimHash of a whole text: A-Z lower-cased, words between ASCII white space, shingles of
    `size` words with repeats (the whole sequence if there are fewer words); a bit is set if it is
    set in over half of the shingles' XXH64. No words: 0."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - size + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(flat[a:b], SEED) for a, b in zip(starts, ends[len(words) - n:].tolist())), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        bits = np.unpackbits(hashes[at:at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def with_fingerprints(df: DataFrame, text: str, size: int = 4) -> DataFrame:
    """`df` without `text`, with `fp`, the fingerprint as a signed long."""
    import pyspark.sql.types as T

    kept = [f for f in df.schema.fields if f.name != text]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in batch[text]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch[f.name] for f in kept], pa.array(fps)], names=[*[f.name for f in kept], "fp"])

    return df.mapInArrow(mark, T.StructType([*kept, T.StructField("fp", T.LongType())]))


def build(keys: np.ndarray) -> dict[str, np.ndarray]:
    """Path-compressed binary trie over sorted distinct uint64 keys.

    Node i < n - 1 is the branching between keys i and i + 1, nodes n - 1 ... 2n - 2 are the leaves. Every node
    covers keys[lo:hi], which share the first `depth` bits.
    """
    n = len(keys)
    lo, hi = np.empty(2 * n - 1, np.int64), np.empty(2 * n - 1, np.int64)
    depth = np.full(2 * n - 1, BITS, np.int64)
    leaf = np.arange(n)
    lo[n - 1:], hi[n - 1:] = leaf, leaf + 1
    left, right = np.full(2 * n - 1, -1, np.int64), np.full(2 * n - 1, -1, np.int64)
    # common prefix of neighbours; by halves, as a double holds 53 bits only
    diff = keys[1:] ^ keys[:-1]
    top, low = (diff >> np.uint64(HALF)).astype(np.int64), (diff & np.uint64(2**HALF - 1)).astype(np.int64)
    length = lambda x: np.frexp(x.astype(np.float64))[1]
    lcp = np.where(top > 0, HALF - length(top), BITS - length(low))
    depth[:n - 1] = lcp
    # a node reaches to the nearest neighbours that branch above it
    walls = np.array([0, n])
    owner = np.full(n + 1, -1, np.int64)
    for d in np.unique(lcp):
        at = np.flatnonzero(lcp == d) + 1
        k = np.searchsorted(walls, at)
        lo[at - 1], hi[at - 1] = walls[k - 1], walls[k]
        owner[at] = d
        walls = np.sort(np.concatenate([walls, at]))
    # the parent of a range is the deeper of the branchings at its two ends
    for node in (slice(0, n - 1), slice(n - 1, 2 * n - 1)):
        a, b, ids = lo[node], hi[node], np.arange(2 * n - 1)[node]
        up, down = owner[a], owner[b]
        is_left = (down >= up) & (down >= 0)
        is_right = ~is_left & (up >= 0)
        left[b[is_left] - 1] = ids[is_left]
        right[a[is_right] - 1] = ids[is_right]
    return {"lo": lo, "hi": hi, "depth": depth, "left": left, "right": right, "leaf": np.arange(2 * n - 1) >= n - 1}


def root(trie: dict[str, np.ndarray]) -> int:
    n = (len(trie["lo"]) + 1) // 2
    return int(np.flatnonzero((trie["lo"] == 0) & (trie["hi"] == n))[0])


def forest(pieces: list[np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, list[int]]:
    """The tries of several key arrays under common numbers: (nodes, all keys, roots)."""
    tries, roots, nodes, keys = [], [], 0, 0
    for piece in pieces:
        t = build(piece)
        roots.append(root(t) + nodes)
        for side in ("left", "right"):
            t[side] = np.where(t[side] >= 0, t[side] + nodes, -1)
        t["lo"], t["hi"] = t["lo"] + keys, t["hi"] + keys
        nodes, keys = nodes + len(t["lo"]), keys + len(piece)
        tries.append(t)
    return {k: np.concatenate([t[k] for t in tries]) for k in tries[0]}, np.concatenate(pieces), roots


def link(pieces: list[np.ndarray], budget: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the keys of two pieces, or within a single one, as a spanning forest.

    Node pairs of the trie are traversed together. The differing bits of the shared part of
    both prefixes are counted; a pair goes when they exceed `budget`, or `first` within the first half.
    A pair also goes when all its keys are linked already, so a dense group costs no more than
    the links that span it. Returns (keys, least linked key) for every key that is not its own.
    """
    t, keys, roots = forest(pieces)
    n = len(keys)
    head = keys[t["lo"]]
    group = np.arange(n)
    changes = np.arange(n)  # where the group changes along the keys, summed
    low_half = np.uint64(2**HALF - 1)

    def near(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        x = (head[u] ^ head[v]) & MASKS[np.minimum(t["depth"][u], t["depth"][v])]
        return (np.bitwise_count(x) <= budget) & (np.bitwise_count(x & ~low_half) <= first)

    def unite(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal group, changes
        while True:
            ga, gb = group[a], group[b]
            open_ = ga != gb
            if not open_.any():
                break
            a, b, ga, gb = a[open_], b[open_], ga[open_], gb[open_]
            up = np.arange(n)
            np.minimum.at(up, np.maximum(ga, gb), np.minimum(ga, gb))
            while True:
                jump = up[up]
                if (jump == up).all():
                    break
                up = jump
            group = up[group]
        changes = np.concatenate([[0], np.cumsum(group[1:] != group[:-1])])

    stack = [(np.array([roots[0]]), np.array([roots[-1]]))]
    while stack:
        u, v = stack.pop()
        if len(u) > CHUNK:
            stack.append((u[:-CHUNK], v[:-CHUNK]))
            u, v = u[-CHUNK:], v[-CHUNK:]
        a, b = t["lo"][u], t["lo"][v]
        same = (group[a] == group[b]) & (changes[t["hi"][u] - 1] == changes[a]) & (changes[t["hi"][v] - 1] == changes[b])
        u, v = u[~same], v[~same]
        done = t["leaf"][u] & t["leaf"][v]
        if done.any():
            unite(t["lo"][u[done]], t["lo"][v[done]])
            u, v = u[~done], v[~done]
        own = u == v
        l, r = t["left"][u[own]], t["right"][u[own]]
        u, v = u[~own], v[~own]
        swap = t["depth"][v] < t["depth"][u]
        u, v = np.where(swap, v, u), np.where(swap, u, v)
        x = np.concatenate([l, r, l, t["left"][u], t["right"][u]])
        y = np.concatenate([l, r, r, v, v])
        fine = (x == y) & ~t["leaf"][x] | (x != y)
        x, y = x[fine], y[fine]
        fine = near(x, y)
        if fine.any():
            stack.append((x[fine], y[fine]))
    moved = np.flatnonzero(group != np.arange(n))
    return keys[moved], keys[group[moved]]


def _cells(fps: DataFrame, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefixes (left-aligned) and depths of trie nodes that cover all keys, at most about `target` keys
    each. Counted eight levels at a time, below the nodes that are still too large."""
    done: list[tuple[int, int]] = []
    hot: list[int] | None = None
    for depth in range(8, BITS + 1, 8):
        prefix = F.shiftrightunsigned("fp", BITS - depth)
        rows = fps.select(prefix.alias("p"))
        if hot is not None:
            above = fps.sparkSession.createDataFrame([(h,) for h in hot], "p long")
            rows = fps.select(prefix.alias("p"), F.shiftrightunsigned("fp", BITS - depth + 8).alias("above"))
            rows = rows.join(F.broadcast(above.withColumnRenamed("p", "above")), "above").select("p")
        counts = {r["p"] & (2**64 - 1): r["n"] for r in rows.groupBy("p").agg(F.count("*").alias("n")).collect()}
        by_top: dict[int, dict[int, int]] = {}
        for p, n in counts.items():
            by_top.setdefault(p >> 8, {})[p] = n
        following: list[int] = []
        for top, leaves in by_top.items():
            stack = [(top, depth - 8, leaves)]
            while stack:
                p, d, mine = stack.pop()
                if sum(mine.values()) <= target or d == BITS:
                    done.append((p << (BITS - d), d))
                elif d == depth:
                    following.append(p)
                else:
                    for bit in (0, 1):
                        child = p << 1 | bit
                        part = {k: n for k, n in mine.items() if k >> (depth - d - 1) == child}
                        if part:
                            stack.append((child, d + 1, part))
        if not following:
            break
        hot = following
    done.sort()
    return np.array([p for p, _ in done], np.uint64), np.array([d for _, d in done], np.int64)


def _cell_pairs(prefix: np.ndarray, depth: np.ndarray, budget: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i <= j of cells that keys within the budget may lie in."""
    a, b = [], []
    for i in range(len(prefix)):
        x = (prefix[i] ^ prefix[i:]) & MASKS[np.minimum(depth[i], depth[i:])]
        near = (np.bitwise_count(x) <= budget) & (np.bitwise_count(x >> np.uint64(HALF)) <= first)
        j = np.flatnonzero(near) + i
        a.append(np.full(len(j), i))
        b.append(j)
    return np.concatenate(a), np.concatenate(b)


def trie_links(fps: DataFrame, budget: int, first: int, target: int = CELL) -> DataFrame:
    """Links (a, b) of distinct keys `fp` with at most `budget` differing bits, of these at most `first` in
    the first half, as spanning forests of the tasks."""
    prefix, depth = _cells(fps, target)
    empty = fps.sparkSession.createDataFrame([], "a long, b long")
    if not len(prefix):
        return empty
    one, two = _cell_pairs(prefix, depth, budget, first)
    # tasks of each cell
    tasks, member = np.tile(np.arange(len(one)), 2), np.concatenate([one, two])
    keep = np.concatenate([np.ones(len(one), bool), one != two])
    tasks, member = tasks[keep], member[keep]
    order = np.argsort(member, kind="stable")
    tasks, offsets = tasks[order], np.concatenate([[0], np.cumsum(np.bincount(member, minlength=len(prefix)))])
    shared = fps.sparkSession.sparkContext.broadcast((prefix, tasks, offsets, one, two))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, tasks, offsets, _, _ = shared.value
        for batch in batches:
            fp = batch["fp"].to_numpy()
            cell = np.searchsorted(prefix, fp.view(np.uint64), "right") - 1
            times = offsets[cell + 1] - offsets[cell]
            at = np.repeat(offsets[cell] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            yield pa.RecordBatch.from_arrays([pa.array(tasks[at]), pa.array(np.repeat(fp, times))], names=["task", "fp"])

    def run(key, pdf):
        prefix, _, _, one, two = shared.value
        i, j = one[key[0]], two[key[0]]
        fp = np.unique(pdf["fp"].to_numpy().view(np.uint64))
        if i == j:
            pieces = [fp]
        else:
            pieces = [p for p in np.split(fp, [np.searchsorted(fp, prefix[j])]) if len(p)]
            if len(pieces) < 2:
                return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        a, b = link(pieces, budget, first)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = fps.mapInArrow(deal, "task long, fp long")
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(len(one), 4 * fps.sparkSession.sparkContext.defaultParallelism))
    return dealt.repartition(parts, "task").groupBy("task").applyInPandas(run, "a long, b long")


def near_groups(fps: DataFrame, doc_id: str = "doc_id", budget: int = 4, cell: int = CELL) -> DataFrame:
    """Classes of linked fingerprints: one row (fp, component_id) per distinct fingerprint.

    Two fingerprints link at `budget` or fewer differing bits; one of their halves then differs in
    at most half the budget. So the self-join runs over two tries, with the first half as it
    is and with the halves swapped, and prunes early in each: the second trie need not
    find what the first has found, so its leading half may differ in less than half the budget. The upper
    levels of the traversal place pairs of cells (trie nodes of a bounded number of keys) in tasks, so that no
    hot prefix meets in one task. component_id is the smallest id that is reachable.
    """
    distinct = cut(fps.groupBy("fp").agg(F.min(doc_id).alias("rep")), "fingerprints")
    target = max(cell, distinct.count() // MAX_CELLS)
    half = budget // 2
    links = trie_links(distinct.select("fp"), budget, half, target)
    if budget - half - 1 >= 0:
        turned = distinct.select(_turn("fp").alias("fp"))
        second = trie_links(turned, budget, budget - half - 1, target)
        links = links.union(second.select(_turn("a").alias("a"), _turn("b").alias("b")))
    classes = components(links)
    named = distinct.join(classes.select(F.col("v").alias("fp"), F.col("m").alias("class")), "fp", "left")
    named = named.withColumn("class", F.coalesce("class", "fp"))
    least = named.groupBy("class").agg(F.min("rep").alias("component_id"))
    return named.join(least, "class").select("fp", "component_id")


def _turn(c: str):
    return F.shiftleft(F.col(c), HALF).bitwiseOR(F.shiftrightunsigned(F.col(c), HALF))


def simhash_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 4, budget: int = 4) -> DataFrame:
    """One row per document: doc_id, fp (signed long), fingerprint (16 hex digits), component_id.

    Whole texts are read. Null and empty texts have fingerprint 0 and link like any other; repeated
    rows give repeated rows; rows without an id take part and get the class's smallest id (null if
    the class has none). An empty table gives no rows.
    """
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fps = cut(with_fingerprints(ids, "text", size), "simhash")
    groups = near_groups(fps, budget=budget)
    return fps.join(groups, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 4, budget: int = 4) -> DataFrame:
    """`docs` with one document of each class, the one with the smallest id; of repeated rows of that
    id one stays. Rows without an id cannot be named and stay."""
    groups = simhash_groups(docs, text, doc_id, size, budget)
    keep = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("_keep")).distinct()
    named = docs.filter(F.col(doc_id).isNotNull())
    kept = named.join(keep, named[doc_id] == keep["_keep"]).drop("_keep")
    return kept.dropDuplicates([doc_id]).unionByName(docs.filter(F.col(doc_id).isNull()))
