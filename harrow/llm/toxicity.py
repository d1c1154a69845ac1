"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, revive

#: A word, or a run of marks; the heads of a word are terms as well.
WORD = re.compile(r"[^\W_]+")
HEADS = (3, 4, 5)
FACTORS = 8
#: Words whose terms a worker remembers before it starts anew.
REMEMBERED = 400_000


def terms(word: str) -> list[int]:
    """Hashes of a word and of its heads."""
    out = [zlib.crc32(b"w" + word.encode("utf-8", "surrogatepass"))]
    return out + [zlib.crc32(b"%d" % n + word[:n].encode("utf-8", "surrogatepass")) for n in HEADS if len(word) >= n]


def distinct_words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


class Model:
    """score = sigmoid(w0 + sum w + pairwise products), over the set of a text's hashed terms that the model holds."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.at = {int(h): i for i, h in enumerate(hashes)}
        rng = np.random.default_rng(11)
        self.bias = 0.0
        self.linear = np.zeros(len(hashes))
        self.factors = rng.standard_normal((len(hashes), FACTORS)) * 0.01
        self.slope, self.shift = 1.0, 0.0
        self.words: dict[str, tuple[int, ...]] = {}

    def features(self, text: str | None) -> np.ndarray:
        get, at = self.words.get, self.at.get
        found: set[int] = set()
        for word in distinct_words(text):
            own = get(word)
            if own is None:
                own = tuple(i for h in terms(word) if (i := at(h)) is not None)
                if len(self.words) >= REMEMBERED:
                    self.words.clear()
                self.words[word] = own
            if own:
                found.update(own)
        return np.array(sorted(found), np.int64)

    def raw(self, ids: np.ndarray) -> float:
        v = self.factors[ids]
        total = v.sum(axis=0)
        return float(self.bias + self.linear[ids].sum() + 0.5 * (total @ total - (v * v).sum()))

    def score(self, text: str | None) -> float:
        z = self.slope * self.raw(self.features(text)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def bag(text: str | None) -> np.ndarray:
    """The set of a text's hashed terms."""
    return np.unique(np.fromiter((h for w in distinct_words(text) for h in terms(w)), np.uint32))


def choose(bags: list[np.ndarray], y: np.ndarray, size: int, least: int = 2) -> np.ndarray:
    """At most `size` terms that tell the labels apart best, each in at least `least` texts and with a G statistic
    that chance would reach for less than about one of all terms."""
    sides = [np.unique(np.concatenate([np.zeros(0, np.uint32), *[x for x, k in zip(bags, y) if k == label]]), return_counts=True) for label in (0, 1)]
    n = np.array([(y == label).sum() for label in (0, 1)])
    keys = np.union1d(sides[0][0], sides[1][0])
    c = np.zeros((len(keys), 2))
    for label, (found, times) in enumerate(sides):
        c[np.searchsorted(keys, found), label] = times
    often = c.sum(axis=1) >= least
    keys, c = keys[often].astype(np.int64), c[often]
    if not len(keys):
        return keys
    cells = [c[:, 0], c[:, 1], n[0] - c[:, 0], n[1] - c[:, 1]]
    total, has = float(n.sum()), c.sum(axis=1)
    expect = [has * n[0] / total, has * n[1] / total, (total - has) * n[0] / total, (total - has) * n[1] / total]
    with np.errstate(divide="ignore", invalid="ignore"):
        g = sum(np.where(o > 0, o * np.log(o / np.maximum(e, 1e-12)), 0) for o, e in zip(cells, expect))
    fine = 2 * g > 2 * np.log(len(keys))
    keys, g = keys[fine], g[fine]
    return np.sort(keys[np.lexsort((keys, -g))[:size]])


def fit(texts: list[str], labels: list[int], size: int = 2048, epochs: int = 30, rate: float = 0.3, decay: float = 1e-4, seed: int = 5, threshold: float = 0.3) -> Model:
    """Adagrad on the log loss; a fifth of the texts is kept out to calibrate: the slope by the log loss, the shift so
    that `threshold` is the score that parts the kept-out labels best (F1)."""
    y = np.array(labels, np.int64)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    kept, train = (order[:len(order) // 5], order[len(order) // 5:]) if len(order) >= 50 else (order, order)
    bags = [bag(text) for text in texts]
    model = Model(choose([bags[i] for i in train], y[train], size))
    sets = [np.flatnonzero(np.isin(model.hashes, found)) for found in bags]
    del bags
    prior = min(max(y[train].mean(), 1e-3), 1 - 1e-3) if len(train) else 0.5
    model.bias = float(np.log(prior / (1 - prior)))
    g_linear, g_factors, g_bias = np.full(len(model.hashes), 1e-8), np.full(model.factors.shape, 1e-8), 1e-8
    for _ in range(epochs):
        for i in rng.permutation(train):
            ids = sets[i]
            v = model.factors[ids]
            total = v.sum(axis=0)
            z = model.bias + model.linear[ids].sum() + 0.5 * (total @ total - (v * v).sum())
            slope = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[i]
            g_bias += slope * slope
            model.bias -= rate * slope / np.sqrt(g_bias)
            if not len(ids):
                continue
            d = slope + decay * model.linear[ids]
            g_linear[ids] += d * d
            model.linear[ids] -= rate * d / np.sqrt(g_linear[ids])
            d = slope * (total - v) / len(ids) + decay * v
            g_factors[ids] += d * d
            model.factors[ids] -= 0.2 * rate * d / np.sqrt(g_factors[ids])
    # Platt scaling on the texts kept out
    z, t = np.array([model.raw(sets[i]) for i in kept]), y[kept].astype(float)
    n1, n0 = t.sum(), len(t) - t.sum()
    if n1 and n0:
        goal = np.where(t > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -500, 500)))
            w, r = p * (1 - p) + 1e-9, p - goal
            # a weak pull to the uncalibrated score keeps separable texts finite
            hess = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1]])
            da, db = np.linalg.solve(hess, [(r * z).sum() + a - 1, r.sum() + b])
            da, db = float(np.clip(da, -0.5, 0.5)), float(np.clip(db, -1, 1))
            a, b = a - da, b - db
            if abs(da) + abs(db) < 1e-9:
                break
        if np.isfinite([a, b]).all():
            model.slope = float(np.clip(a, 0.1, 10))
        order = np.argsort(-z, kind="stable")
        high, hits = z[order], np.cumsum(t[order])
        ends = np.flatnonzero(np.append(high[1:] != high[:-1], True))
        f1 = 2 * hits[ends] / (ends + 1 + n1)
        at = int(ends[np.argmax(f1)])
        below = high[at + 1] if at + 1 < len(high) else high[at] - 2
        model.shift = float(np.log(threshold / (1 - threshold)) - model.slope * (high[at] + below) / 2)
    return model


def sample(docs: DataFrame, labels: DataFrame, per_label: int, max_chars: int, text: str, doc_id: str, label: str) -> list[tuple[str, int]]:
    """Labelled texts by hash of the id: at most `per_label` of label 1 and three times as many of label 0."""
    marks = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(label).alias("class"))
    rows = docs.filter(F.col(text).isNotNull() & (F.length(text) <= max_chars)).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return bounded_sample(marks.join(rows.select("id"), "id"), rows, lambda y: per_label if y == 1 else 3 * per_label)


def toxicity(
    docs: DataFrame, labelled: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
    threshold: float = 0.3, per_label: int = 2000, max_chars: int = 20_000,
) -> DataFrame:
    """One row per document: `row` (the input), score (0 to 1) and predicted (score >= threshold).

    The machine is fitted on texts of `labelled` joined with `labels`: at most `per_label` of label 1 and three
    times as many of label 0, each of at most `max_chars` characters; it is broadcast (a bounded number
    of terms). The set of terms of every whole text is scored. Null and empty texts have no
    terms and get the score of the intercept; without labelled rows the score is that of an even
    prior. Of several labels of an id the highest counts. Repeated rows score alike; an empty table gives
    no rows.
    """
    rows = sample(labelled, labels, per_label, max_chars, text, doc_id, label)
    shared = docs.sparkSession.sparkContext.broadcast(vars(fit([t for t, _ in rows], [y for _, y in rows], threshold=threshold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = revive(Model, shared.value)
        for batch in batches:
            score = np.array([model.score(t.as_py()) for t in batch["text"]], np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["row", "score", "predicted"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    schema = T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return packed.mapInArrow(run, schema)
