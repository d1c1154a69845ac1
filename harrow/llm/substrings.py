"""Exact removal of repeated byte strings by suffix arrays of co-located shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .induced import equal_neighbours, suffix_array

#: Length of the grams among which every window picks its anchor.
GRAM = 24
#: Contexts of a shard.
SHARD = 16_384
#: Bits of a sieve, which is broadcast; a full one lets everything through and costs nothing but time.
SIEVE_BITS = 1 << 27
#: Bytes of documents taken together, and contexts that are handed on at once.
CHUNK = 1 << 20
AT_ONCE = 8192
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SALTS = tuple(np.uint64(j * 0x9E3779B97F4A7C15 % 2**64) for j in (1, 2, 3))
BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def anchors(buf: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Anchors of all windows of `size` bytes that lie within a document: (document, anchor, first window, last
    window, anchor hash), positions in `buf`. `ends` are the documents' ends.

    A window's anchor is its gram with the least hash, the last of several; so equal windows have their
    anchor at the same place, wherever they stand. The windows of an anchor follow one another.
    """
    n = len(buf)
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    if n < size:
        return none
    power = np.cumprod(np.full(n, MULTIPLIER))
    inverse = np.cumprod(np.full(n, np.uint64(pow(int(MULTIPLIER), -1, 2**64))))
    total = np.concatenate([[np.uint64(0)], np.cumsum(BYTES[buf] * power)])
    h = mix64((total[GRAM:] - total[:-GRAM]) * inverse[:n - GRAM + 1])
    low = np.uint64(2**32 - 1)  # the position, in the lower half of the key
    key = h & ~low | (low - np.arange(len(h), dtype=np.uint64))
    width, reach = size - GRAM + 1, 1
    while reach * 2 <= width:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    if reach < width:
        key = np.minimum(key[:len(key) - (width - reach)], key[width - reach:])
    at = (low - (key & low)).astype(np.int64)
    window = np.arange(len(at))
    doc = np.searchsorted(ends, window, "right")
    inside = window + size <= ends[doc]
    window, at, doc = window[inside], at[inside], doc[inside]
    if not len(window):
        return none
    fresh = np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(window)) - 1
    return doc[first], at[first], window[first], window[last], h[at[first]]


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, bytes, np.ndarray, np.ndarray]]:
    """Documents of a batch in runs of about CHUNK bytes: (row numbers, bytes, starts, ends)."""
    rows, parts, held = [], [], 0
    for k, text in enumerate(batch["text"]):
        raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
        rows.append(k)
        parts.append(raw)
        held += len(raw)
        if held >= CHUNK or k == batch.num_rows - 1:
            ends = np.cumsum([len(p) for p in parts])
            yield np.array(rows), b"".join(parts), np.concatenate([[0], ends[:-1]]), ends
            rows, parts, held = [], [], 0


class Sieve:
    """A set of 64-bit keys as bits of a fixed number; may let further keys through."""

    @staticmethod
    def places(keys: np.ndarray) -> list[np.ndarray]:
        return [(mix64(keys + salt) % np.uint64(SIEVE_BITS)).astype(np.int64) for salt in SALTS]

    @staticmethod
    def of(keys: DataFrame) -> np.ndarray:
        """The bits of a column `key`, gathered word by word: at most SIEVE_BITS / 64 rows reach the driver."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.concatenate(Sieve.places(batch["key"].to_numpy().view(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

        words = keys.select("key").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
        out = np.zeros(SIEVE_BITS // 64, np.uint64)
        found = words.toArrow()
        out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
        return out

    @staticmethod
    def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in Sieve.places(keys):
            out &= (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return out


def place_key(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A key of an anchor's place, from the hash of the document's id."""
    return mix64(doc.view(np.uint64) ^ mix64(at.view(np.uint64)))


def _anchor_hashes(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw, _, ends in chunks(batch):
                h = anchors(np.frombuffer(raw, np.uint8), ends, size)[4]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["key"])

    return docs.select("text").mapInArrow(run, "key long")


def _places(docs: DataFrame, size: int, bits) -> DataFrame:
    """Anchors that may be repeated: (h, ctx, doc_id, at, lo, hi). ctx hashes all windows of the anchor and where it
    stands in them; `at` is the document's tie-breaker and the anchor's position; the windows begin
    lo to hi bytes before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            tie = batch["tie"].to_numpy()
            for rows, raw, starts, ends in chunks(batch):
                doc, at, first, last, h = anchors(np.frombuffer(raw, np.uint8), ends, size)
                kept = Sieve.passes(bits.value, h)
                doc, at, first, last, h = doc[kept], at[kept], first[kept], last[kept], h[kept]
                ctx = np.fromiter((digest(raw[a:b], c) for a, b, c in zip(first.tolist(), (last + size).tolist(), (at - first).tolist())), np.uint64, len(doc))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(ctx.view(np.int64)), batch["doc_id"].take(pa.array(rows[doc])),
                     pa.array(tie[rows[doc]] << 32 | (at - starts[doc])), pa.array((at - last).astype(np.int16)), pa.array((at - first).astype(np.int16))],
                    names=["h", "ctx", "doc_id", "at", "lo", "hi"])

    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("ctx", T.LongType()), docs.schema["doc_id"],
                           T.StructField("at", T.LongType()), T.StructField("lo", T.ShortType()), T.StructField("hi", T.ShortType())])
    return docs.select("doc_id", "tie", "text").mapInArrow(run, schema)


def _contexts(docs: DataFrame, size: int, bits, hot: dict[int, int], shards: int) -> DataFrame:
    """Bytes around the anchors to compare: (shard, doc_id, at, lo, hi, bytes). Anchors with very many contexts are
    cut into slices of window places, as windows only match at the same place."""
    names = ("shard", "row", "at", "lo", "hi", "bytes")

    def told(batch: pa.RecordBatch, out: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(out["shard"], pa.int64()), batch["doc_id"].take(pa.array(out["row"], pa.int64())), pa.array(out["at"], pa.int64()),
             pa.array(out["lo"], pa.int16()), pa.array(out["hi"], pa.int16()), pa.array(out["bytes"], pa.binary())],
            names=["shard", "doc_id", "at", "lo", "hi", "bytes"])

    hot_keys = np.array(sorted(hot), np.int64)
    hot_slices = np.array([hot[k] for k in sorted(hot)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tie, dh = batch["tie"].to_numpy(), batch["dh"].to_numpy()
            for rows, raw, starts, ends in chunks(batch):
                doc, at, first, last, h = anchors(np.frombuffer(raw, np.uint8), ends, size)
                mark = tie[rows[doc]] << 32 | (at - starts[doc])
                kept = Sieve.passes(bits.value, place_key(dh[rows[doc]], mark))
                out: dict[str, list] = {k: [] for k in names}
                keys = h.view(np.int64)
                near = np.searchsorted(hot_keys, keys) if len(hot_keys) else np.zeros(len(keys), np.int64)
                slices = np.ones(len(keys), np.int64)
                if len(hot_keys):
                    is_hot = hot_keys[np.minimum(near, len(hot_keys) - 1)] == keys
                    slices[is_hot] = hot_slices[near[is_hot]]
                for i in np.flatnonzero(kept).tolist():
                    lo, hi, n = int(at[i] - last[i]), int(at[i] - first[i]), int(slices[i])
                    for s in range(n):
                        a, b = max(lo, s * size // n), min(hi, (s + 1) * size // n - 1)
                        if a > b:
                            continue
                        out["shard"].append((int(h[i]) + s) % shards)
                        out["row"].append(int(rows[doc[i]]))
                        out["at"].append(int(mark[i]))
                        out["lo"].append(a)
                        out["hi"].append(b)
                        out["bytes"].append(raw[int(at[i]) - b:int(at[i]) - a + size])
                    if len(out["row"]) >= AT_ONCE:  # what a task holds does not follow the contexts of a chunk
                        yield told(batch, out)
                        out = {k: [] for k in names}
                yield told(batch, out)

    schema = T.StructType([T.StructField("shard", T.LongType()), docs.schema["doc_id"], T.StructField("at", T.LongType()),
                           T.StructField("lo", T.ShortType()), T.StructField("hi", T.ShortType()), T.StructField("bytes", T.BinaryType())])
    return docs.select("doc_id", "tie", "dh", "text").mapInArrow(run, schema)


def repeated_windows(pdf: pd.DataFrame, size: int) -> pd.DataFrame:
    """Windows of a shard's contexts that also start earlier, as byte spans (doc_id, tie, start, end).

    The contexts are laid out in order of document and place, so a window's first occurrence is its least
    position in the shard. In the suffix array equal windows are neighbours.
    """
    pdf = pdf.drop_duplicates(["doc_id", "at", "hi"]).sort_values(["doc_id", "at", "hi"], ascending=[True, True, False], na_position="first", kind="stable")
    t = np.frombuffer(b"".join(pdf["bytes"]), np.uint8)
    counts = (pdf["hi"] - pdf["lo"] + 1).to_numpy(np.int64)
    begin = np.concatenate([[0], np.cumsum(counts + size - 1)[:-1]])
    owner = np.repeat(np.arange(len(pdf)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = begin[owner] + offset
    is_start = np.zeros(len(t), bool)
    is_start[starts] = True
    sa = suffix_array(t)
    sa = sa[is_start[sa]]
    group = np.concatenate([[0], np.cumsum(~equal_neighbours(t, sa, size))])
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    later = np.zeros(len(t), bool)
    later[sa] = sa != np.minimum.reduceat(sa, edge)[group]
    gone = later[starts]
    run = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
    # a run may go on from one context to the next; it is cut there
    cut_at = np.cumsum(counts)
    pieces = np.unique(np.concatenate([run, cut_at[(cut_at < len(gone))]]))
    a, b = pieces[:-1], pieces[1:]
    keep = gone[a] if len(a) else np.zeros(0, bool)
    a, b = a[keep], b[keep]
    at = pdf["at"].to_numpy()[owner[a]]
    first = (at & 0xFFFFFFFF) - pdf["hi"].to_numpy(np.int64)[owner[a]] + offset[a]
    return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[owner[a]], "tie": at >> 32, "start": first, "end": first + (b - a) + size - 1})


def drop_repeated_bytes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 100, shard: int = SHARD) -> DataFrame:
    """One row per document: `row` (the input), n_bytes, `removed` (spans of bytes), kept (the remaining bytes).

    A byte goes if a string of `size` bytes covers it that also starts earlier: in a document with smaller
    id, or in the same one at an earlier place. Strings are judged on the input.

    Strings that are equal have the same anchor, so anchors bring all occurrences of a string together:
    1. anchors that occur twice are counted and broadcast as a sieve of fixed size;
    2. of places with the same anchor and the same bytes around it the first stays, all windows of
       the others are repeated;
    3. the first ones, where an anchor has several, go to shards with their bytes; a shard's suffix
       array, made by induced sorting, finds their repeated windows.
    Shards follow from the number of contexts; an anchor with more than a shard holds is cut into slices of
    window places. Counts and firsts are combined before the shuffle; the driver holds the sieve and one
    row per hot anchor.

    Null and empty texts have no bytes. Rows that repeat id and text are one document; texts that share an
    id are ordered by hash. A missing id counts as the smallest. An empty table gives no rows.
    """
    spark = docs.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    base = docs.select(row.alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    base = base.withColumn("tie", F.pmod(F.xxhash64("text"), F.lit(1 << 31))).withColumn("dh", F.xxhash64("doc_id"))

    seen = _anchor_hashes(base, size).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    sieve = spark.sparkContext.broadcast(Sieve.of(seen))
    places = cut(_places(base, size, sieve), "places", "zstd")
    firsts = cut(places.groupBy("h", "ctx").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n")), "firsts", "zstd")
    copies = places.join(firsts.filter("n > 1").drop("n"), ["h", "ctx"]).filter(~F.struct("doc_id", "at").eqNullSafe(F.col("first")))
    place = F.col("at").bitwiseAND(0xFFFFFFFF)
    whole = copies.select("doc_id", F.shiftright("at", 32).alias("tie"), (place - F.col("hi")).alias("start"), (place - F.col("lo") + size).alias("end"))

    several = cut(firsts.groupBy("h").agg(F.count("*").alias("contexts")).filter("contexts > 1"), "several")
    n = several.agg(F.sum("contexts")).first()[0] or 0
    shards = max(1, n // shard)
    hot = {r["h"]: min(size, -(-r["contexts"] // shard)) for r in several.filter(F.col("contexts") > shard).collect()}
    reps = firsts.join(several, "h").select(F.xxhash64("first.doc_id").alias("dh"), F.col("first.at").alias("at"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = place_key(batch["dh"].to_numpy(), batch["at"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    chosen = spark.sparkContext.broadcast(Sieve.of(reps.mapInArrow(keys, "key long")))
    contexts = _contexts(base, size, chosen, hot, shards)
    kind = base.schema["doc_id"].dataType.simpleString()
    compared = contexts.groupBy("shard").applyInPandas(
        lambda pdf: repeated_windows(pdf, size), f"doc_id {kind}, tie long, start long, end long")

    # a document's spans, bounded by its own bytes
    spans = whole.unionByName(compared).groupBy("doc_id", "tie").agg(F.collect_set(F.struct("start", "end")).alias("hits"))
    spans = spans.withColumnsRenamed({"doc_id": "did", "tie": "own"})
    joined = base.join(spans, base["doc_id"].eqNullSafe(spans["did"]) & (base["tie"] == spans["own"]), "left")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size_, removed, kept = [], [], []
            for value, hits in zip(batch["text"], batch["hits"]):
                raw = (value.as_py() or "").encode("utf-8", "surrogatepass")
                merged: list[list[int]] = []
                for s, e in sorted((x["start"], x["end"]) for x in hits.as_py() or []):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([s, e])
                at, parts = 0, []
                for s, e in merged:
                    parts.append(raw[at:s])
                    at = e
                size_.append(len(raw))
                removed.append([{"start": s, "end": e} for s, e in merged])
                kept.append(b"".join([*parts, raw[at:]]))
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.array(size_, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["row", "n_bytes", "removed", "kept"])

    return joined.select("row", "text", "hits").mapInArrow(
        apply, f"row {docs.schema.simpleString()}, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
