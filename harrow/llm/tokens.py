"""Token ids of documents in compressed binary files, and their way back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rans
from .common import cut, portions

#: Tokens after which a block closes at the next document end, and tokens of a file.
BLOCK_TOKENS = 1 << 20
FILE_TOKENS = 1 << 25
#: Encoded pieces that a worker remembers before it starts anew.
REMEMBERED = 1_000_000
#: Characters that are looked up at once, and unknown pieces that are encoded as one text.
PORTION, TOGETHER = 1 << 20, 96


class Encoder:
    """Whole texts to ids with the tokenizers library.

    Byte-level BPE splits a text before every blank that a visible character follows, whatever stands around, so
    a text is cut there and each distinct piece is encoded once per worker; pieces that many texts lack are
    encoded in one go. Texts with other runs of blanks are encoded whole. Strings of special tokens become their ids, as the
    library does it; they are parts of pieces as well.
    """

    def __init__(self, spec: str, kind: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.kind, self.inner, self.leading = kind, {}, {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # a byte is one character in a byte-level vocabulary
        added = self.tokenizer.get_added_tokens_decoder()
        for i, token in added.items():
            self.bytes_of[i] = len(token.content.encode())
        self.uncut = any(" " in token.content or token.lstrip or token.rstrip for token in added.values())

    def whole(self, text: str) -> bytes:
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found[0].ids, self.kind).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces, each with its blank, in lines of a few; token lengths tell them apart."""
        lines = [" " + " ".join(pieces[i:i + TOGETHER]) for i in range(0, len(pieces), TOGETHER)]
        ids = np.array([i for line in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False) for i in line.ids], self.kind)
        upto, ends = np.cumsum(self.bytes_of[ids]), np.cumsum([len(p.encode()) + 1 for p in pieces])
        cut = np.searchsorted(upto, ends)
        if not (upto[cut] == ends).all():
            raise ValueError("the tokenizer is not a byte-level one")
        blob, ends = ids.tobytes(), ((cut + 1) * ids.itemsize).tolist()
        self.inner.update(zip(pieces, [blob[a:b] for a, b in zip([0, *ends], ends)]))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.inner) > REMEMBERED:  # short pieces recur most
            self.inner = {k: v for k, v in self.inner.items() if len(k) <= 7}
            if len(self.inner) > REMEMBERED // 2:
                self.inner = {}
        if len(self.leading) > REMEMBERED // 10:
            self.leading.clear()
        cut = [None if self.uncut else text.split(" ") for text in texts]
        first = [None if pieces is None else pieces.pop(0) for pieces in cut]
        unknown = set(chain.from_iterable(pieces for pieces in cut if pieces)).difference(self.inner)
        # blanks that white space or nothing follows; pieces of this kind are never known
        uneven = {piece for piece in unknown if not piece or piece[0].isspace()}
        if uneven:
            cut = [None if pieces and not uneven.isdisjoint(pieces) else pieces for pieces in cut]
            unknown = set(chain.from_iterable(pieces for pieces in cut if pieces)).difference(self.inner)
        self._learn(list(unknown))
        new = list({lead for lead, pieces in zip(first, cut) if pieces is not None}.difference(self.leading))
        for lead, found in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            self.leading[lead] = np.array(found.ids, self.kind).tobytes()
        get = self.inner.__getitem__
        return [self.whole(text) if pieces is None else self.leading[lead] + b"".join(map(get, pieces)) for text, lead, pieces in zip(texts, first, cut)]


def tokenize(docs: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id", end: int = 0) -> tuple[DataFrame, int]:
    """(doc_id, n_tokens, ids) of whole texts, null as empty, each with `end` appended; and the bytes of an id."""
    import os

    from tokenizers import Tokenizer

    spec = Path(tokenizer_path).read_text(encoding="utf-8")
    width = 2 if max(Tokenizer.from_str(spec).get_vocab_size(), end + 1) <= 1 << 16 else 4
    # a worker keeps the broadcast dictionary over its tasks, and with it its encoder and the pieces it knows
    shared = docs.sparkSession.sparkContext.broadcast({"spec": spec})
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = shared.value
        encoder, tail = own.get("encoder") or own.setdefault("encoder", Encoder(own["spec"], kind)), np.array([end], kind).tobytes()
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            blobs = [blob + tail for begin, end in portions(texts, PORTION) for blob in encoder(texts[begin:end])]
            sizes = pa.array([len(b) // width for b in blobs], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], sizes, pa.array(blobs, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("doc_id", ids.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return ids.mapInArrow(run, schema), width


def counts(tokens: DataFrame, width: int) -> np.ndarray:
    """How often each id occurs in all documents; partitions send one row per id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(np.frombuffer(b"".join(batch["ids"].to_pylist()), f"<u{width}"), minlength=len(total))
            found[:len(total)] += total
            total = found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, np.int64)
    out[rows["id"]] = rows["n"]
    return out


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id", end: int = 0,
    block_tokens: int = BLOCK_TOKENS, file_tokens: int = FILE_TOKENS, bits: int = 18,
) -> None:
    """Encode documents into `path`.

    `path/table` holds the frequency table which all blocks share, `path/blocks` files of independent blocks in
    ascending id order (file, then block): the ids of whole documents coded by a range asymmetric numeral
    system in interleaved lanes, lane states and stream offsets at checkpoints, and checksums of
    the coded and the plain ids. Files are written by Spark, so lost tasks leave nothing half done.

    Null texts are empty and hold the end id only. Rows without id come first; repeated ids are
    neighbours, ordered by length. An empty table gives empty files. Frequencies are of all documents.
    """
    spark = docs.sparkSession
    made, width = tokenize(docs, tokenizer_path, text, doc_id, end)
    tokens = cut(made, "tokens", "zstd")
    n = counts(tokens, width)
    bits = max(bits, int(np.count_nonzero(n)).bit_length() + 1)
    freq = rans.quantize(n, bits)
    spark.createDataFrame([(bits, freq.astype("<u4").tobytes())], "bits int, freq binary").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast((freq, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, before = TaskContext.get().partitionId(), 0, 0
        table = rans.Table(*shared.value)
        held, sizes, blobs, n = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal seq, before, n
            ids = np.frombuffer(b"".join(blobs), f"<u{width}")
            coded = rans.encode(ids, table)
            row = {"part": part, "block": seq, "start": before, "n_tokens": len(ids), "doc_ids": list(held), "lengths": list(sizes), **coded}
            seq, before, n = seq + 1, before + len(ids), 0
            held.clear(), sizes.clear(), blobs.clear()
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in arrow], schema=arrow)

        for batch in batches:
            for d, size, blob in zip(batch["doc_id"].to_pylist(), batch["n_tokens"].to_pylist(), batch["ids"].to_pylist()):
                held.append(d)
                sizes.append(size)
                blobs.append(blob)
                n += size
                if n >= block_tokens:
                    yield close()
        if held:
            yield close()

    from pyspark.sql.pandas.types import to_arrow_schema

    kind = tokens.schema["doc_id"].dataType
    fields = [("part", T.IntegerType()), ("block", T.IntegerType()), ("start", T.LongType()), ("n_tokens", T.LongType()),
              ("doc_ids", T.ArrayType(kind)), ("lengths", T.ArrayType(T.LongType())), ("lanes", T.IntegerType()), ("payload", T.BinaryType()),
              ("steps", T.BinaryType()), ("offsets", T.BinaryType()), ("states", T.BinaryType()), ("payload_crc", T.LongType()), ("ids_crc", T.LongType())]
    schema = T.StructType([T.StructField(a, b) for a, b in fields])
    arrow = to_arrow_schema(schema)
    files = max(spark.sparkContext.defaultParallelism, int(n.sum()) // file_tokens + 1)
    ordered = tokens.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "n_tokens")
    ordered.mapInArrow(run, schema).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files of `write_tokens`; start is the number
    of ids of all documents before it. Blocks are decoded independently of each other, and their checksums verified."""
    blocks = spark.read.parquet(f"{path}/blocks")
    row = spark.read.parquet(f"{path}/table").first()
    shared = spark.sparkContext.broadcast((np.frombuffer(row["freq"], "<u4").astype(np.int64), row["bits"]))
    # one row per file
    totals = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    before, at = {}, 0
    for part in sorted(totals):
        before[part] = at
        at += totals[part]
    kind = blocks.schema["doc_ids"].dataType.elementType
    fields = [("doc_id", kind), ("start", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType())]
    if ids:
        fields.append(("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType([T.StructField(a, b) for a, b in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(*shared.value)
        for batch in batches:
            for block in batch.to_pylist():
                flat = rans.decode(block, block["n_tokens"], table).astype("<u4")
                size = np.array(block["lengths"], np.int64)
                ends = np.cumsum(size)
                begins = ends - size
                crc = [zlib.crc32(flat[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
                start = begins + before[block["part"]] + block["start"]
                out = [pa.array(block["doc_ids"], batch["doc_ids"].type.value_type), pa.array(start), pa.array(size), pa.array(crc, pa.int64())]
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return blocks.mapInArrow(run, schema)
