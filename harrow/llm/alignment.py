"""Alignment of the tokens of two tokenizers over the same bytes, by interval coalescing, and counts of linked ids."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, portions

#: Characters of text after which a block of documents closes, and that are looked up at once.
BLOCK_SIZE = 1 << 23
PORTION = 1 << 19
#: Pieces and their bytes that a worker remembers before it starts anew, at the end of a block.
REMEMBERED, REMEMBERED_BYTES = 400_000, 1 << 25
#: Pieces that are tokenized as one line.
LINE = 4096
#: A blank between two visible characters: both tokenizers begin a token there, whatever stands around.
CUT = re.compile(r"(?<=\S) (?=\S)")
UNEVEN = re.compile(r" \s|\s |\A | \Z")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for a byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def a_bytes(tokenizer) -> list[bytes]:
    """The bytes of every id of a byte-level tokenizer; added tokens are plain strings."""
    alphabet, vocabulary = byte_alphabet(), tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
    return out


def b_bytes(pieces: list[str]) -> list[bytes]:
    """The bytes of every sentencepiece piece: U+2581 is a blank, <0xHH> a byte."""
    one = re.compile(r"<0x([0-9A-F]{2})>")
    return [bytes([int(m[1], 16)]) if (m := one.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]


def decoded(raw: bytes | None) -> str:
    """A text, empty if it is missing or no UTF-8."""
    try:
        return (raw or b"").decode()
    except UnicodeDecodeError:
        return ""


def coalesce(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of A and of B tokens of every group, where both sides are tokens that follow each other from byte 0.

    All intervals are sorted by start; a group ends where a start reaches the largest end so far.
    """
    starts = np.concatenate([np.concatenate([[0], a_ends[:-1]]), np.concatenate([[0], b_ends[:-1]])])
    ends, side = np.concatenate([a_ends, b_ends]), np.repeat([0, 1], [len(a_ends), len(b_ends)])
    order = np.lexsort((side, ends, starts))
    reach = np.maximum.accumulate(ends[order])
    group = np.concatenate([[0], np.cumsum(starts[order][1:] >= reach[:-1])])
    n = int(group[-1]) + 1
    return np.bincount(group[side[order] == 0], minlength=n), np.bincount(group[side[order] == 1], minlength=n)


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places whose intervals share a byte: the overlaps within the groups, expanded."""
    a_starts, b_starts = np.concatenate([[0], a_ends[:-1]]), np.concatenate([[0], b_ends[:-1]])
    first, last = np.searchsorted(b_ends, a_starts, "right"), np.searchsorted(b_starts, a_ends, "left")
    n = np.maximum(last - first, 0)
    a = np.repeat(np.arange(len(a_ends)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


class Aligner:
    """Alignments of pieces of text, remembered.

    A text is cut at blanks between visible characters. No byte-level token of the pattern of A reaches over such a
    blank, and no piece of B does if its vocabulary has none with a blank after another character (else texts stay whole), so
    a piece is aligned once and its alignment is that of all its occurrences.
    """

    def __init__(self, a_spec: str, b_model: bytes, links: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_spec)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_a, self.bytes_b = a_bytes(self.a), b_bytes(pieces)
        self.size_a, self.size_b = (np.array([len(x) for x in of], np.int64) for of in (self.bytes_a, self.bytes_b))
        self.whole = any(re.search("[^▁]▁", p) for p in pieces)
        self.ends_only = links == "ends"
        self.text_a, self.text_b = [str(i) for i in range(len(self.bytes_a))], [str(i) for i in range(len(self.bytes_b))]
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes, self.codes = array("q"), array("q")  # A tokens, B tokens, groups, links of a piece; codes of its links
        self.unspelt: set[int] = set()
        self.held = 0

    def pieces(self, text: str) -> list[str]:
        if self.whole:
            return [text]
        return CUT.split(text) if UNEVEN.search(text) else text.split(" ")

    def learn(self, pieces: list[str]) -> None:
        plain, odd = [], []
        for p in pieces:
            # a line is cut again where visible characters meet its blanks
            (odd if self.whole or not p or p[0].isspace() or p[-1].isspace() else plain).append(p)
        lines = [plain[i:i + LINE] for i in range(0, len(plain), LINE)] + [[p] for p in odd]
        while lines:
            texts = [" ".join(line) for line in lines]
            found_a = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
            found_b = self.b.encode(texts, num_threads=1)
            again = []
            for line, text, a, b in zip(lines, texts, found_a, found_b):
                a, raw = a.ids, (" " + text).encode()
                if b"".join([self.bytes_a[i] for i in a]) == raw == b"".join([self.bytes_b[i] for i in b]):
                    self.align(line, np.array(a, np.int64), np.array(b, np.int64))
                elif len(line) > 1:  # tells which of them it is
                    again += [[p] for p in line]
                else:
                    self.unspelt.add(len(self.groups))
                    self.keep(line[0], "", (0, 0, 0, 0))
            lines = again

    def keep(self, piece: str, groups: str, sizes: tuple[int, int, int, int]) -> None:
        self.at[piece] = len(self.groups)
        self.groups.append(groups)
        self.sizes.extend(sizes)
        self.held += len(piece) + 16 * sizes[3]

    def links_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of the pieces at these places, and the codes of all their links."""
        sizes = np.frombuffer(self.sizes, np.int64).reshape(-1, 4) if self.sizes else np.zeros((0, 4), np.int64)
        begins = np.cumsum(sizes[:, 3]) - sizes[:, 3]
        n = sizes[places, 3]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins[places], n)
        return sizes[places], np.frombuffer(self.codes, np.int64)[at] if len(at) else at

    def align(self, line: list[str], a: np.ndarray, b: np.ndarray) -> None:
        a_ends, b_ends = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        in_a, in_b = coalesce(a_ends, b_ends)
        to_a, to_b = np.cumsum(in_a), np.cumsum(in_b)
        x, y = overlaps(a_ends, b_ends)
        if self.ends_only:
            together = a_ends[x] == b_ends[y]
            x, y = x[together], y[together]
        code = a[x] * len(self.bytes_b) + b[y]
        # pieces end where groups do
        stops = np.cumsum([len(p.encode()) + 1 for p in line])
        last = np.searchsorted(a_ends[to_a - 1], stops)
        if not (a_ends[to_a[last] - 1] == stops).all():
            raise ValueError("a token reaches over a blank between visible characters")
        upto = np.searchsorted(x, to_a[last])
        sa, sb = [self.text_a[i] for i in a.tolist()], [self.text_b[i] for i in b.tolist()]
        la, lb = to_a.tolist(), to_b.tolist()
        told = [",".join(sa[p:q]) + "|" + ",".join(sb[r:s]) for p, q, r, s in zip([0, *la], la, [0, *lb], lb)]
        g = n = 0
        for piece, stop, k in zip(line, (last + 1).tolist(), upto.tolist()):
            before = (la[g - 1], lb[g - 1]) if g else (0, 0)
            sizes = (la[stop - 1] - before[0], lb[stop - 1] - before[1], stop - g, k - n)
            self.keep(piece, ";".join(told[g:stop]), sizes)
            g, n = stop, k
        self.codes.frombytes(code.tobytes())

    def __call__(self, texts: list[str]) -> list[list[int]]:
        """Places of the alignments of the pieces of each text; none for a text that a piece does not spell."""
        cut = [self.pieces(text) if text else [] for text in texts]
        missing = list(set(chain.from_iterable(cut)).difference(self.at))
        if missing:
            self.learn(missing)
        found = [list(map(self.at.__getitem__, pieces)) for pieces in cut]
        return [[] if self.unspelt and not self.unspelt.isdisjoint(places) else places for places in found]


def align(
    docs: DataFrame, a_path: str, b_path: str, text: str = "text", keep: list[str] | None = None, links: str = "ends", groups: bool = False,
    block_size: int = BLOCK_SIZE,
) -> DataFrame:
    """One row per document: row (the columns `keep`, by default all but the text), n_a, n_b, n_groups, n_links,
    groups_sha256, n_best, count_sum, and with `groups` the groups as text (`a1,a2|b1;a3|b2,b3`).

    A is a byte-level tokenizer of the tokenizers library and gets a blank before the text, B a sentencepiece model that
    adds one itself. Strings of special tokens are plain text. Groups are the shortest runs of tokens of both sides that cover the same bytes. Links
    are pairs of an A and a B token that end at the same byte (`links="ends"`) or that share a byte (`links="overlaps"`). The
    count of an id pair is the number of its links in all documents; n_best are a document's links whose count is
    the highest of their B id, ties included, count_sum the sum of the counts of its links.

    Texts that are null, empty or no UTF-8, or whose tokens of either side do not spell the text, have no tokens: zeros, and '' for
    groups and digest. Long texts are cut at blanks and need no more than their own size in tokens. Repeated rows each count. An
    empty table gives no rows. Only `keep` is carried, packed, so names of other columns do not matter.

    Documents are dealt with in blocks of about `block_size` characters: a block sends each id pair once, so that a frequent pair, like all others, has
    one row per block; the counts of its pairs come back to the block, and to nothing larger.
    """
    import sentencepiece

    spec, model = Path(a_path).read_text(encoding="utf-8"), Path(b_path).read_bytes()
    vocabulary = sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size()
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    # workers keep the broadcast dictionary over their tasks, and with it the pieces they know
    shared = docs.sparkSession.sparkContext.broadcast({"a": spec, "b": model})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = shared.value
        aligner = own.get("aligner") or own.setdefault("aligner", Aligner(own["a"], own["b"], links))
        part, seq, size, rows, found = TaskContext.get().partitionId(), 0, 0, [], []

        def close() -> pa.RecordBatch:
            """The block's documents; its last row has the block's pieces as well."""
            lengths = np.array([len(x) for x in found], np.int64)
            flat = np.fromiter(chain.from_iterable(found), np.int64, int(lengths.sum()))
            used, place, times = np.unique(flat, return_inverse=True, return_counts=True)
            rank = np.argsort(-times, kind="stable")  # frequent pieces get small numbers, which compress well
            number = np.empty(len(rank), np.int64)
            number[rank] = np.arange(len(rank))
            used, times, place = used[rank], times[rank], number[place]
            sizes, codes = aligner.links_of(used)
            pairs, ordinal = np.unique(codes, return_inverse=True)
            often = np.bincount(ordinal, np.repeat(times, sizes[:, 3]), len(pairs)).astype(np.int64)
            ends = np.cumsum(lengths)
            whole = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(sizes[place], axis=0)])
            told = whole[ends] - whole[ends - lengths]
            texts = [";".join([aligner.groups[i] for i in x]) for x in found]
            kind = "<u2" if len(used) <= 1 << 16 else "<u4"
            blob, width = place.astype(kind).tobytes(), int(kind[2])
            last = len(rows) - 1
            only = lambda value: [None] * last + [value]
            columns = [
                pa.array([part << 32 | seq] * len(rows), pa.int64()), pa.concat_arrays(rows), *[pa.array(told[:, k]) for k in range(4)],
                pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]), pa.array(texts if groups else [None] * len(texts), pa.string()),
                pa.array([blob[p:q] for p, q in zip(((ends - lengths) * width).tolist(), (ends * width).tolist())], pa.binary()),
                pa.array(only(width), pa.int32()), pa.array(only(sizes[:, 3].astype("<u4").tobytes()), pa.binary()), pa.array(only(ordinal.astype("<u4").tobytes()), pa.binary()),
                pa.array(only(pairs), pa.list_(pa.int64())), pa.array(only(often), pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            whole = [decoded(value.as_py()) for value in batch["text"]]
            for begin, end in portions(whole, PORTION):
                found += aligner(whole[begin:end])
                rows += [batch["row"].slice(k, 1) for k in range(begin, end)]
                size += sum(map(len, whole[begin:end]))
                if size >= block_size:
                    yield close()
                    seq, size, rows, found = seq + 1, 0, [], []
                    if len(aligner.groups) > REMEMBERED or aligner.held > REMEMBERED_BYTES:
                        aligner.clear()
        if rows:
            yield close()

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(text).cast("binary").alias("text"))
    long, blob = T.LongType(), T.BinaryType()
    fields = [("block", long), ("row", nullable(packed.schema["row"].dataType)), ("n_a", long), ("n_b", long), ("n_groups", long), ("n_links", long), ("groups_sha256", T.StringType()),
              ("groups", T.StringType()), ("places", blob), ("width", T.IntegerType()), ("sizes", blob), ("ordinals", blob), ("pairs", T.ArrayType(long)), ("times", T.ArrayType(long))]
    schema = T.StructType([T.StructField(a, b) for a, b in fields])
    blocks = cut(packed.mapInArrow(run, schema), "aligned", "zstd")
    rows = T.StructType([*schema.fields[1:8], T.StructField("n_best", long), T.StructField("count_sum", long)])
    out = blocks.drop("pairs", "times").groupBy("block").cogroup(counted(blocks, vocabulary).groupBy("of")).applyInArrow(totals, rows)
    return out if groups else out.drop("groups")


def nullable(kind: T.StructType) -> T.StructType:
    """The type with every part nullable, as tasks return it."""
    text = kind.json()
    for part in ("nullable", "containsNull", "valueContainsNull"):
        text = text.replace(f'"{part}":false', f'"{part}":true')
    return T.StructType.fromJson(json.loads(text))


def counted(blocks: DataFrame, vocabulary: int) -> DataFrame:
    """(of, pair, count, best) of the pairs of every block: the count in all blocks, and whether it is the highest
    of the pair's B id."""
    pairs = blocks.filter("pairs is not null").select(F.col("block").alias("of"), F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    pairs = pairs.select("of", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    counts = cut(pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair") % vocabulary), "pair_counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))  # a B id has at most one pair for each A id
    known = counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    return pairs.select("of", "pair").join(known, "pair").select("of", "pair", "count", "best")


def totals(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """The documents of a block with the sums over their links."""
    docs = docs.combine_chunks()
    held = docs.filter(pa.compute.is_valid(docs["width"])).to_pylist()[0]
    order = np.argsort(pairs["pair"].to_numpy())
    count, best = pairs["count"].to_numpy()[order], pairs["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64)
    ordinal, n = np.frombuffer(held["ordinals"], "<u4"), np.frombuffer(held["sizes"], "<u4").astype(np.int64)
    ends = np.cumsum(n)
    sums = []
    for value in (best, count):
        upto = np.concatenate([[0], np.cumsum(value[ordinal])])
        piece, kind = upto[ends] - upto[ends - n], f"<u{held['width']}"
        sums.append(pa.array([int(piece[np.frombuffer(x, kind)].sum()) for x in docs["places"].to_pylist()], pa.int64()))
    return pa.Table.from_arrays([*docs.columns[1:8], *sums], names=[*docs.column_names[1:8], "n_best", "count_sum"])
