"""Benchmark decontamination: an FM-index per training shard, searched for the benchmark's windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .fmindex import FMIndex

#: Benchmark words searched in one pass; a larger benchmark takes several passes.
PASS_WORDS = 5_000_000
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
#: Bytes that part words (ASCII without letters and digits), and A-Z to a-z; the rest stays.
TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of a whole text: A-Z lower-cased, runs of ASCII letters and digits and of anything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TO_WORDS).split()


class Windows:
    """The distinct windows of some benchmark items, as word numbers from 2 on (0 ends a shard, 1 parts runs)."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        found: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            w = words(text)
            for i in range(max(1, len(w) - size + 1) if w else 0):
                found.setdefault(tuple(w[i:i + size]), set()).update([] if item is None else [item])
        self.number = {w: i + 2 for i, w in enumerate(sorted({w for window in found for w in window}))}
        self.items = [sorted(x) for x in found.values()]
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.matrix = np.zeros((len(found), size), np.int64)
        for k, window in enumerate(found):
            self.matrix[k, size - len(window):] = [self.number[w] for w in window]


def search(texts: list[list[bytes]], windows: Windows) -> tuple[list[np.ndarray], list[set[str]]]:
    """For each text the mask of its hit words and the items whose windows occur.

    The shard's index holds the runs of benchmark words that are as long as the shortest window;
    no occurrence can leave such a run.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    start = np.concatenate([[0], np.cumsum(sizes)])
    get = windows.number.get
    s = np.fromiter((get(w, 1) for t in texts for w in t), np.int64, start[-1])
    hit, items = np.zeros(len(s) + 1, np.int64), [set() for _ in texts]
    if len(s) and len(windows.lengths):
        known = s > 1
        edge = np.zeros(len(s) + 1, bool)
        edge[start] = True
        edge[1:-1] |= known[1:] != known[:-1]
        at = np.flatnonzero(edge)
        length = np.diff(at)
        good = known[at[:-1]] & (length >= windows.lengths.min())
        begin, length = at[:-1][good], length[good]
        # runs one after another, each followed by the separator
        place = np.cumsum(length + 1) - length - 1
        flat = np.ones(int((length + 1).sum()), np.int64)
        offset = np.repeat(begin - place, length)
        slot = np.arange(len(offset)) + np.repeat(np.arange(len(length)), length)
        back = np.zeros(len(flat), np.int64)
        back[slot] = slot + offset
        flat[slot] = s[back[slot]]
        if len(flat):
            index = FMIndex(flat, len(windows.number) + 2)
            lo, hi = index.search(windows.matrix, windows.lengths)
            times = np.maximum(hi - lo, 0)
            which = np.repeat(np.arange(len(times)), times)
            rows = np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(times.sum())
            pos = back[index.locate(rows)]
            np.add.at(hit, pos, 1)
            np.add.at(hit, pos + windows.lengths[which], -1)
            doc = np.searchsorted(start, pos, "right") - 1
            for d, w in np.unique(np.stack([doc, which]), axis=1).T.tolist():
                items[d].update(windows.items[w])
    mask = np.cumsum(hit[:-1]) > 0
    return [mask[a:b] for a, b in zip(start[:-1].tolist(), start[1:].tolist())], items


def spans(mask: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as (start, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def cut_words(text: str, gone: list[tuple[int, int]]) -> str:
    """The text without these words; a line end takes the place of every span."""
    raw = text.encode("utf-8", "surrogatepass")
    word = np.frombuffer(raw.translate(TO_WORDS), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]])))
    at, parts = 0, []
    for a, b in gone:
        parts.append(raw[at:edge[2 * a]])
        at = edge[2 * b - 1]
    return b"\n".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass")


def _passes(benchmark: DataFrame, item_id: str, text: str, size: int, pass_words: int) -> list[list[tuple]]:
    """The benchmark in slices of bounded size; there is one unless it is very large."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    out, held = [[]], 0
    for r in rows.orderBy("item", "text").toLocalIterator():
        n = len(words(r["text"]))
        if out[-1] and held + n > pass_words:
            out.append([])
            held = 0
        out[-1].append((r["item"], r["text"]))
        held += n
    return out


def find(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    size: int = 10, clean: bool = False, pass_words: int = PASS_WORDS,
) -> DataFrame:
    """One row per document: `row` (the input), kept, n_words, `spans` of hit words (start, end) and `items`,
    the ids (text) of benchmark items with an occurring window.

    A window is `size` consecutive words of an item, or all words of a shorter one. Each Arrow
    batch of documents is a shard with an FM-index of its own; the documents are not shuffled and all of
    a text is searched. The windows are broadcast in slices of at most `pass_words` benchmark words; further
    slices are further passes over the uncut text, each written, which add their spans and items to the row.

    With clean=True the hit words of all slices are cut out of `kept` at once, and again until no window of any
    slice is left; else kept is the text. Null and empty texts have no words; items without words have no windows;
    windows of an item without id hit, but name no item. Repeated documents are judged
    each, repeated items count once. Empty tables: no rows, or no hits.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    state = docs.select(
        row.alias("row"), F.col(text).alias("kept"), F.lit(-1).alias("n_words"), none.alias("spans"), none.alias("fresh"),
        F.lit(True).alias("open"), F.expr("cast(array() as array<string>)").alias("items"))
    parts = _passes(benchmark, item_id, item_text, size, pass_words)
    several, first = len(parts) > 1, True
    while True:
        for part in parts:
            state = _search_pass(state, part, size, first, clean and not several)
            if several:
                state = cut(state, "decontamination")
        first = False
        if not (clean and several) or state.filter(F.size("fresh") > 0).isEmpty():
            return state.select("row", "kept", "n_words", "spans", "items")
        state = _cut_pass(state)


def _search_pass(state: DataFrame, part: list[tuple], size: int, first: bool, clean: bool) -> DataFrame:
    """Adds the hits of a slice of the benchmark to `fresh`, the spans in `kept` as it is; in the first round also to
    `spans` and `items`. Closed rows, whose text has not changed since all slices were searched, are passed by. With clean=True, for a
    benchmark of one slice, the texts are cut as well, until no window is left."""
    shared = state.sparkSession.sparkContext.broadcast(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(shared.value, size)
        for batch in batches:
            texts, open_ = batch["kept"].to_pylist(), batch["open"].to_pylist()
            split = [words(t) if o else [] for t, o in zip(texts, open_)]
            masks, items = search(split, windows)
            fresh = []
            for old, mask in zip(batch["fresh"].to_pylist(), masks):
                for s in old:
                    mask[s["start"]:s["end"]] = True
                fresh.append([{"start": a, "end": b} for a, b in spans(mask)])
            out, n_words, named = batch["spans"], batch["n_words"], batch["items"]
            if first:
                out, n_words = pa.array(fresh, SPANS), pa.array([len(w) for w in split], pa.int32())
                named = pa.array([sorted(i | set(old)) for i, old in zip(items, named.to_pylist())], pa.list_(pa.string()))
            gone = {k: spans(m) for k, m in enumerate(masks) if clean and m.any()}
            while gone:
                for k in gone:
                    texts[k] = cut_words(texts[k], gone[k])
                again, _ = search([words(texts[k]) for k in gone], windows)
                gone = {k: spans(m) for k, m in zip(list(gone), again) if m.any()}
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.array(texts, pa.string()), n_words, out, pa.array(fresh, SPANS), batch["open"], named],
                names=["row", "kept", "n_words", "spans", "fresh", "open", "items"])

    return state.mapInArrow(run, state.schema)


def _cut_pass(state: DataFrame) -> DataFrame:
    """Cuts the fresh spans out of `kept`; only rows that had some stay open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [[(s["start"], s["end"]) for s in x] for x in batch["fresh"].to_pylist()]
            texts = [cut_words(t, g) if g else t for t, g in zip(batch["kept"].to_pylist(), gone)]
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.array(texts, pa.string()), batch["n_words"], batch["spans"], pa.array([[] for _ in gone], SPANS),
                 pa.array([bool(g) for g in gone]), batch["items"]], names=["row", "kept", "n_words", "spans", "fresh", "open", "items"])

    return state.mapInArrow(run, state.schema)


def digest(found: DataFrame, *columns: str) -> DataFrame:
    """Counts of `find`: n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        *columns, F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
