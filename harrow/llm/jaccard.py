"""Near-duplicates: SimHash links of the trie, checked by the exact Jaccard similarity of word shingles, and a prefix-filtered
set join for the similar texts that no bit budget reaches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.sources.sinks import release, stage

from .common import components, cut
from .simhash import fingerprint, near_groups
from .substrings import Sieve

#: Documents sampled for frequent shingles, and how many of these are told to the tasks. They only set the order of a
#: document's shingles; any common order gives the same pairs.
SAMPLE = 20_000
FREQUENT = 200_000


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 of a text's shingles, words as in `simhash.fingerprint`; all words if there are fewer."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    return np.array(sorted({digest(b" ".join(w[i:i + size])) for i in range(max(1, len(w) - size + 1))} if w else ()), np.uint64)


def name(tokens: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(tokens.tobytes())).view(np.int64))


def _frequent(texts: DataFrame, size: int) -> np.ndarray:
    """The most frequent shingles of a bounded sample of texts, least frequent first."""
    n = texts.count()
    part = texts.filter(F.pmod("tie", F.lit(1 << 30)) < int(min(1, SAMPLE / max(1, n)) * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), size) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], names=["t"])

    counts = part.select("text").mapInArrow(run, "t long").groupBy("t").agg(F.count("*").alias("n")).filter("n > 1")
    top = counts.orderBy(F.desc("n"), "t").limit(FREQUENT).toArrow()
    return top["t"].to_numpy()[::-1].view(np.uint64)


def parities(s: np.ndarray) -> bytes:
    """Whether an even or an odd number of a set's shingles falls on each of 2^k places, about as many as there are shingles. Two sets
    differ in at least as many shingles as their parities differ in places."""
    places = max(256, 1 << int(len(s) - 1).bit_length()) if len(s) else 256
    return np.packbits((np.bincount((s % np.uint64(places)).astype(np.int64), minlength=places) & 1).astype(np.uint8)).tobytes()


def folded(p: bytes) -> bytes:
    """Parities on 256 places."""
    a = np.frombuffer(p, np.uint8)
    while len(a) > 32:
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    return a.tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Places in which two parities differ, on the places of the shorter one."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(b) > len(a):
        b = b[:len(b) // 2] ^ b[len(b) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def packed(s: np.ndarray) -> bytes:
    """The upper 48 bits of sorted hashes."""
    return np.ascontiguousarray((s >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _prefixes(texts: DataFrame, size: int) -> DataFrame:
    """Rows (v, n, first, tie, fp, prefix, parities, sign) of the distinct shingle sets: name, size, least (id, tie), a text's tie and
    fingerprint, the rarest n - ceil(0.8 n) + 1 shingles (two sets with a similarity of 0.8 or more share one of these), and parities,
    also on 256 places as four longs."""
    order = _frequent(texts, size)
    at = np.argsort(order)
    shared = texts.sparkSession.sparkContext.broadcast((order[at], at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        for batch in batches:
            v, n, fp, prefix, odd = [], [], [], [], []
            for text in batch["text"]:
                s = shingles(text.as_py(), size)
                fp.append(fingerprint(text.as_py(), size))
                v.append(name(s))
                n.append(len(s))
                odd.append(parities(s))
                if len(known) and len(s):
                    k = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    s = s[np.argsort(np.where(known[k] == s, rank[k], -1), kind="stable")]
                prefix.append(s[:len(s) - (4 * len(s) + 4) // 5 + 1].view(np.int64))
            sign = np.frombuffer(b"".join(map(folded, odd)), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["tie"], pa.array(v, pa.int64()), pa.array(n, pa.int32()), pa.array(np.array(fp, np.uint64).view(np.int64)),
                 pa.array(prefix, pa.list_(pa.int64())), pa.array(odd, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * 4, pa.int32()), pa.array(sign))],
                names=["doc_id", "tie", "v", "n", "fp", "prefix", "parities", "sign"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.select("doc_id", "tie", "text").mapInArrow(run, f"doc_id {kind}, tie long, v long, n int, fp long, prefix array<long>, parities binary, sign array<long>")
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "tie"))
    return cut(rows.groupBy("v").agg(
        F.min(named).alias("first"), F.min("tie").alias("tie"), F.min("fp").alias("fp"), *[F.first(c).alias(c) for c in ("n", "prefix", "parities", "sign")]), "shingle_sets")


def _tokens(sets: DataFrame) -> DataFrame:
    """(v, n, pos, t) of the prefix shingles that several sets may have; a shingle of one set links nothing. Most are of this kind, and
    only their hashes are shuffled."""
    seen = sets.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = sets.sparkSession.sparkContext.broadcast(Sieve.of(seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["prefix"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat, owner = batch["prefix"].flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            kept = Sieve.passes(shared.value, flat.view(np.uint64))
            own = pa.array(owner[kept])
            yield pa.RecordBatch.from_arrays([batch["v"].take(own), batch["n"].take(own), pa.array(pos[kept].astype(np.int32)), pa.array(flat[kept])], names=["v", "n", "pos", "t"])

    return cut(sets.select("v", "n", "prefix").mapInArrow(run, "v long, n int, pos int, t long"), "tokens")


def _similar(pairs: DataFrame, sets: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of 0.8 or more.

    Sets of that similarity differ in at most a ninth of their shingles together, so parities exclude most others. What remains is decided by
    the sets, made again from one text of each.
    """
    spark = sets.sparkSession
    side = lambda x, c: sets.select(F.col("v").alias(x), F.col("n").alias(f"n{x}"), F.col(c).alias(f"p{x}"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch["na"].to_numpy().astype(np.int64) + batch["nb"].to_numpy()
            differ = np.fromiter((apart(x.as_buffer(), y.as_buffer()) for x, y in zip(batch["pa"], batch["pb"])), np.int64, batch.num_rows)
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(9 * differ <= n))

    left = pairs.join(side("a", "parities"), "a").join(side("b", "parities"), "b").select("a", "b", "na", "nb", "pa", "pb")
    near, near_at = stage(left.mapInArrow(close, "a long, b long, na int, nb int"), "near")
    ids = near.select(F.col("a").alias("v")).union(near.select(F.col("b").alias("v"))).distinct()
    key = F.xxhash64(F.col("first.doc_id"), F.coalesce(F.col("first.tie"), F.col("tie")))
    wanted = spark.sparkContext.broadcast(Sieve.of(sets.join(ids, "v").select(key.alias("key"))))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = batch["text"].filter(pa.array(Sieve.passes(wanted.value, batch["key"].to_numpy().view(np.uint64))))
            found = [shingles(t.as_py(), size) for t in chosen]
            yield pa.RecordBatch.from_arrays([pa.array([name(s) for s in found], pa.int64()), pa.array([packed(s) for s in found], pa.binary())], names=["v", "s"])

    rows = texts.select(F.xxhash64("doc_id", "tie").alias("key"), "text").mapInArrow(whole, "v long, s binary")
    made, made_at = stage(rows.join(ids, "v", "left_semi").groupBy("v").agg(F.first("s").alias("s")), "shingles", "uncompressed")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch["na"].to_numpy().astype(np.int64) + batch["nb"].to_numpy()
            both = np.fromiter((len(np.intersect1d(unpacked(x.as_buffer()), unpacked(y.as_buffer()), assume_unique=True)) for x, y in zip(batch["sa"], batch["sb"])), np.int64, batch.num_rows)
            # o / (x + y - o) >= 4 / 5
            yield batch.select(["a", "b"]).filter(pa.array(9 * both >= 4 * n))

    side = lambda x: made.select(F.col("v").alias(x), F.col("s").alias(f"s{x}"))
    both = near.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
    out = cut(both.mapInArrow(alike, "a long, b long"), "similar")
    for path in (near_at, made_at):
        release(spark, path)
    return out


def _trie_pairs(sets: DataFrame, budget: int) -> DataFrame:
    """Pairs (a, b) of a set and the least one that the trie of fingerprints links it with, over one or more links of `budget` bits."""
    groups = near_groups(sets.select("fp", F.col("v").alias("doc_id")), budget=budget)
    return sets.select("v", "fp").join(groups, "fp").filter("v <> component_id").select(F.col("component_id").alias("a"), F.col("v").alias("b"))


def _hub_pairs(tokens: DataFrame) -> DataFrame:
    """Pairs (a, b) of a set and one smallest set under its shingles: of those of its own magnitude and the next lower one, the one
    that most of its shingles name. A set has one such pair at most."""
    bucket = F.floor(F.log(F.col("n").cast("double")) * 4).cast("int")
    tokens = tokens.withColumn("bucket", bucket)
    hub = tokens.groupBy("t", "bucket").agg(F.min(F.struct("n", "v")).alias("hub"))
    sought = tokens.select("t", "v", "n", F.explode(F.array("bucket", F.col("bucket") - 1)).alias("bucket"))
    named = sought.join(hub, ["t", "bucket"]).filter("v <> hub.v and hub.n <= n and 5 * hub.n >= 4 * n").groupBy("v", "hub").agg(F.count("*").alias("times"))
    best = named.groupBy("v").agg(F.max_by("hub.v", F.struct("times", -F.col("hub.n"), -F.col("hub.v"))).alias("a"))
    return best.select("a", F.col("v").alias("b"))


def _open_pairs(tokens: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs (a, b) of sets in different classes `m` that share a shingle and that size, position and parities leave open.

    Sets meet in classes of size of a ratio of 1.3: one with the larger ones of its own class and of the next.
    """
    mixed = tokens.groupBy("t").agg(F.min("m").alias("lo"), F.max("m").alias("hi")).filter("lo <> hi").select("t")
    signs = sets.select("v", *[F.get("sign", F.lit(i)).alias(f"s{i}") for i in range(4)])
    rows = tokens.join(mixed, "t").join(signs, "v").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.3))).cast("int"))
    rows = cut(rows, "open")
    one = rows.withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    other = rows.select("t", "band", *[F.col(c).alias(f"{c}_2") for c in ("v", "n", "pos", "m", "s0", "s1", "s2", "s3")])
    differ = " + ".join(f"bit_count(s{i} ^ s{i}_2)" for i in range(4))
    fine = f"m <> m_2 and (n < n_2 or n = n_2 and v < v_2) and 5 * n >= 4 * n_2 and 9 * least(n - pos, n_2 - pos_2) >= 4 * (n + n_2) and 9 * ({differ}) <= n + n_2"
    return one.join(other, ["t", "band"]).filter(fine).select(F.col("v").alias("a"), F.col("v_2").alias("b"))


def similar_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5, budget: int = 4) -> DataFrame:
    """Rows (v, first, class) of the distinct shingle sets; sets with a Jaccard similarity of 0.8 or more are linked and
    `class` is the least name that is reachable.

    Links come in two rounds. First the trie of SimHash fingerprints links sets within `budget` bits, and each set is compared with a
    smallest one under its shingles, so that dense groups are joined at the cost of their rows. Similar sets may differ in
    more bits (17 of 64 were seen), so then come all pairs under a shingle that are in different classes still. All of these
    are decided by whole sets of hashes; nothing is sampled or capped.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    sets = _prefixes(texts, size)
    tokens = _tokens(sets)
    first = _trie_pairs(sets, budget).union(_hub_pairs(tokens)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = _similar(cut(first.distinct(), "pairs"), sets, texts, size)
    tokens = tokens.join(components(links), "v", "left").withColumn("m", F.coalesce("m", "v"))
    more = _similar(cut(_open_pairs(tokens, sets).distinct(), "pairs"), sets, texts, size)
    classes = components(links.union(more))
    return sets.select("v", "first").join(classes, "v", "left").select("v", "first", F.coalesce("m", "v").alias("class"))


def drop_similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5) -> DataFrame:
    """`docs` with one document of each class of similar ones, the one with the smallest id; of repeated rows of that id
    one stays. Rows without an id take part, but cannot be named and stay."""
    keep = similar_classes(docs, text, doc_id, size).groupBy("class").agg(F.min("first").alias("_keep")).select("_keep").filter("_keep is not null")
    named = docs.filter(F.col(doc_id).isNotNull())
    kept = named.join(keep, (named[doc_id] == keep["_keep.doc_id"]) & (F.xxhash64(named[text]) == keep["_keep.tie"]), "left_semi")
    return kept.dropDuplicates([doc_id]).unionByName(docs.filter(F.col(doc_id).isNull()))
