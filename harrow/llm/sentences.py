"""Substring dedup by sliding sentence spans."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .substrings import Sieve

#: A sentence with the marks and white space that end it; a line end closes it as well. Marks that numbers and
#: addresses hold too (3.5, a.org) end it only before white space.
SOFT = ".!?\u2026"
HARD = "\n\u2028\u2029\u0589\u061f\u06d4\u0964\u0965\u1362\u1367\u104a\u104b\u17d4\u17d5\u203c\u2047-\u2049\u3002\ufe52\ufe56\ufe57\uff01\uff0e\uff1f\uff61"
CLOSE = "\"')\\]\u00bb\u2019\u201d\u300d\u300f"
SENTENCE = re.compile(rf"(?:[^{SOFT}{HARD}]++|(?!(?:(?<![{SOFT}])[{SOFT}]++[{CLOSE}]*+(?=[\s{HARD}]|\Z)))[{SOFT}])*+(?:(?:(?<![{SOFT}])[{SOFT}]++[{CLOSE}]*+(?=[\s{HARD}]|\Z)|[{HARD}])[{SOFT}{HARD}]*\s*|\Z)")
#: Scripts that set no blanks between words (Thai, Lao, Burmese, Khmer, kana, Han); each character counts as a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
UNSPACED_CHAR = re.compile(f"[{UNSPACED}]")
WORD = re.compile(rf"\s*(?:[{UNSPACED}]|[^\s{UNSPACED}]+)\s*|\s+$")
#: A sentence of more than LONG words is cut after words whose hash is the least among NEAR words to either side, and LONG
#: words after the last cut at the latest.
LONG = 16
NEAR = 4


def split(text: str | None, long: int = LONG) -> list[str]:
    """The sentences of a text; joined they are the text. One of more than `long` words is cut where its words say
    so, so that the cuts of a repeated passage agree wherever it stands."""
    out: list[str] = []
    for sentence in SENTENCE.findall(text or ""):
        # most sentences have few words, all between blanks
        few = len(sentence.split()) <= long and (sentence.isascii() or not UNSPACED_CHAR.search(sentence))
        if few or len(words := WORD.findall(sentence)) <= long:
            if sentence:
                out.append(sentence)
            continue
        at = 0
        for end in cuts([crc32(w.strip().encode("utf-8", "surrogatepass")) for w in words], long):
            out.append("".join(words[at:end]))
            at = end
    return out


def cuts(hashes: list[int], long: int = LONG, near: int = NEAR) -> list[int]:
    """The ends (exclusive) of the pieces of a long sentence."""
    out, last, n = [], 0, len(hashes)
    for i, h in enumerate(hashes, 1):
        if i == n or i - last >= long or h < min(hashes[max(0, i - 1 - near):i - 1], default=h) and h <= min(hashes[i:i + near]):
            out.append(i)
            last = i
    return out


def run_ends(sentences: list[str], several: int) -> list[int]:
    """For every sentence the end (exclusive) of the run of `several` sentences from it; a shorter text that is not
    blank is one run."""
    if 0 < len(sentences) < several:
        return [len(sentences)] if any(s.strip() for s in sentences) else []
    return list(range(several, len(sentences) + 1))


def runs(sentences: list[str], several: int, min_words: int = 0) -> tuple[list[int], list[bytes]]:
    """The ends of all runs and their words. `min_words` has no effect: runs were once prolonged to it,
    which left the last short sentences of a repeated passage in no run."""
    ends = run_ends(sentences, several)
    flat = [" ".join(s.split()).encode("utf-8", "surrogatepass") for s in sentences]
    return ends, [b" ".join(filter(None, flat[i:e])) for i, e in enumerate(ends)]


def spans(ids: DataFrame, several: int, bits=None) -> DataFrame:
    """Rows (h1, h2, doc_id, at) of every run, or of those that pass the broadcast sieve `bits`: 128 bits of hash, the document, its
    tie-breaker and the first sentence."""

    def cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            row, hashes, start = [], [], []
            for k, text in enumerate(batch["text"]):
                _, keys = runs(split(text.as_py()), several)
                row += [k] * len(keys)
                start += range(len(keys))
                hashes += [digest(x) for x in keys]
            both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            of, begin = np.array(row, np.int64), np.array(start, np.int64)
            if bits is not None:
                kept = Sieve.passes(bits.value, both[:, 0].view(np.uint64))
                both, of, begin = both[kept], of[kept], begin[kept]
            rows = pa.array(of)
            at = batch["tie"].to_numpy()[of] << 32 | begin
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[:, 0]), pa.array(both[:, 1]), batch["doc_id"].take(rows), pa.array(at)], names=["h1", "h2", "doc_id", "at"])

    kind = ids.schema["doc_id"].dataType.simpleString()
    return ids.mapInArrow(cut_runs, f"h1 long, h2 long, doc_id {kind}, at long")


def drop_repeated_spans(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", several: int = 3,
) -> DataFrame:
    """One row per document: `row` (the input), kept (the text without the removed sentences),
    n_sentences, n_removed and `removed`, the spans (start, end) of removed sentences.

    Every run of `several` consecutive sentences, however short, is hashed and joined globally, and a text of fewer
    sentences as a whole. Sentences covered by a run that also starts earlier (smaller id, or the same
    document, earlier start) go; runs are judged on the input. White space does not count. Hashes are counted first, and
    those that repeat are broadcast as a sieve of fixed size, so runs that occur once are not shuffled. The first
    occurrence is a minimum combined before the shuffle; it is written, and the join back has one row per hash on
    that side, so a run that a third of the documents share is split by adaptive execution.

    Null and empty texts have no sentences; kept is then the text itself. Rows that repeat id and text
    are one document and change alike; rows of one id with other texts are told apart by the text's
    hash. A missing id counts as the smallest. An empty table gives no rows.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    packed = packed.withColumn("tie", F.pmod(F.xxhash64("text"), F.lit(1 << 31)))
    ids = packed.select("doc_id", "tie", "text")
    seen = spans(ids, several).groupBy(F.col("h1").alias("key")).agg(F.count("*").alias("n")).filter("n > 1")
    sieve = docs.sparkSession.sparkContext.broadcast(Sieve.of(seen))
    found = cut(spans(ids, several, sieve), "runs", "zstd")
    place = F.struct("doc_id", "at")
    first = cut(found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times"), "first_runs", "zstd")
    later = found.join(first, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    # bounded by a document's own sentences
    start = F.col("at").bitwiseAND(0xFFFFFFFF).cast("int")
    removed = later.groupBy(F.col("doc_id").alias("did"), F.shiftright("at", 32).alias("own")).agg(F.collect_set(start).alias("hits"))
    joined = packed.join(removed, packed["doc_id"].eqNullSafe(removed["did"]) & (packed["tie"] == removed["own"]), "left")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, gone, out = [], [], [], []
            for text, hits in zip(batch["text"], batch["hits"]):
                sentences, text = split(text.as_py()), text.as_py()
                merged: list[list[int]] = []
                starts = sorted(hits.as_py() or [])
                ends = run_ends(sentences, several) if starts else []
                for s, e in [(s, ends[s]) for s in starts]:
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([s, e])
                at, parts = 0, []
                for s, e in merged:
                    parts += sentences[at:s]
                    at = e
                kept.append("".join(parts + sentences[at:]) if merged else text)
                total.append(len(sentences))
                gone.append(sum(e - s for s, e in merged))
                out.append([{"start": s, "end": e} for s, e in merged])
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.array(kept, pa.string()), pa.array(total, pa.int32()), pa.array(gone, pa.int32()),
                 pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=["row", "kept", "n_sentences", "n_removed", "removed"])

    kind = docs.schema.simpleString()
    return joined.select("row", "text", "hits").mapInArrow(
        apply, f"row {kind}, kept string, n_sentences int, n_removed int, removed array<struct<start:int,end:int>>")
