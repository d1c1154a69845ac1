"""Language identification: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, revive

#: Subwords are byte runs of these lengths within a word and its edges, hashed into BUCKETS.
SIZES = (2, 3, 4)
BUCKETS = 1 << 16
WIDTH = 16
#: Bytes hashed at a time.
CHUNK = 1 << 20


def subwords(raw: bytes) -> Iterator[np.ndarray]:
    """Bucket numbers of the subwords of a text (UTF-8), a chunk at a time; white space is one blank, ASCII is lower-cased."""
    text = np.frombuffer(b" " + b" ".join(raw.lower().split()) + b" ", np.uint8)
    reach = max(SIZES)
    for at in range(0, len(text), CHUNK):
        part = text[at:at + CHUNK + reach - 1].astype(np.uint32)
        h = np.zeros(len(part), np.uint32)
        for n in range(1, reach + 1):
            if len(part) < n:
                break
            h = h[:len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1:] + np.uint32(1)
            if n in SIZES:
                mixed = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D + 2 * n)
                yield (mixed[:CHUNK] >> np.uint32(16)).astype(np.int64) % BUCKETS


class Model:
    """Embeddings per bucket, a softmax on their mean, a temperature and a rejection threshold.

    Scoring uses the product of embeddings and softmax weights, a table of one row per bucket: the mean of
    these rows is the same logit.
    """

    def __init__(self, langs: list[str], embedding: np.ndarray, weight: np.ndarray, bias: np.ndarray):
        self.langs, self.bias, self.temperature, self.threshold = langs, bias, 1.0, 0.0
        self.table = np.ascontiguousarray((embedding @ weight).T.astype(np.float32))

    def logits(self, raw: bytes) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for h in subwords(raw):
            total += [row[h].sum(dtype=np.float64) for row in self.table]
            n += len(h)
        return total / max(n, 1) + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], langs: list[str], epochs: int = 12, rate: float = 0.5, seed: int = 7) -> Model:
    """Stochastic gradient descent over documents; a fifth of them is kept out to calibrate.

    The temperature minimises the log loss there. The rejection threshold is the confidence above which
    at most one in a hundred kept-out predictions is wrong.
    """
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    bags = []
    for text in texts:
        h = np.concatenate([*subwords(text.encode("utf-8", "surrogatepass")), np.zeros(0, np.int64)])
        ids, n = np.unique(h, return_counts=True)
        bags.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    y = np.searchsorted(names, langs)
    order = rng.permutation(len(texts))
    kept = order[:len(order) // 5] if len(order) >= 10 else order
    train = order[len(order) // 5:] if len(order) >= 10 else order
    embedding = (rng.standard_normal((BUCKETS, WIDTH)) / WIDTH).astype(np.float32)
    weight, bias = (rng.standard_normal((WIDTH, len(names))) / WIDTH).astype(np.float32), np.zeros(len(names), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(train):
            ids, share = bags[i]
            if not len(ids):
                continue
            mean = share @ embedding[ids]
            z = mean @ weight + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = weight @ p
            weight -= step * np.outer(mean, p)
            bias -= step * 0.1 * p
            # a bucket's gradient is its share; it is scaled up so that rare subwords move as well
            embedding[ids] -= (step * np.minimum(1.0, 50 * share))[:, None] * back
    model = Model(names, embedding, weight, bias)
    z = np.array([model.logits(texts[i].encode("utf-8", "surrogatepass")) for i in kept])
    truth = y[kept]
    losses = []
    grid = np.exp(np.linspace(-3, 3, 61))
    for t in grid:
        model.temperature = t
        p = model.probabilities(z)
        losses.append(-np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-12)).mean())
    model.temperature = float(grid[int(np.argmin(losses))])
    p = model.probabilities(z)
    score, wrong = p.max(axis=1), p.argmax(axis=1) != truth
    by = np.argsort(-score, kind="stable")
    rate_above = np.cumsum(wrong[by]) / np.arange(1, len(by) + 1)
    fine = np.flatnonzero(rate_above <= 0.01)
    model.threshold = float(score[by[fine[-1]]]) if len(fine) else 1.0
    return model


def sample(docs: DataFrame, per_lang: int, max_chars: int, text: str, lang: str, doc_id: str) -> list[tuple[str, str]]:
    """At most `per_lang` whole labelled texts of each language, of at most `max_chars` characters, by hash of the id."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull() & (F.length(text) <= max_chars))
    rows = rows.select(F.col(doc_id).alias("id"), F.col(lang).alias("class"), F.col(text).alias("text"))
    return bounded_sample(rows.select("id", "class"), rows.drop("class"), lambda _: per_lang)


def identify(
    docs: DataFrame, labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
    per_lang: int = 1000, max_chars: int = 20_000,
) -> DataFrame:
    """One row per document: `row` (the input), lang_pred, score (calibrated, 0 to 1), rejected.

    The model is fitted on at most `per_lang` texts of each language of `labelled`, each of at most
    `max_chars` characters, so the sample is bounded; it is broadcast (BUCKETS rows, one column per
    language). All of every text is scored. Texts that are null or have no letter are `und` with score 0
    and rejected; a score below the calibrated threshold is rejected, but keeps its prediction. Without
    labelled rows everything is `und`. Repeated rows score alike; an empty table gives no rows.
    """
    rows = sample(labelled, per_lang, max_chars, text, lang, doc_id)
    model = fit([t for t, _ in rows], [x for _, x in rows]) if rows else None
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter, model = regex.compile(r"\p{L}"), revive(Model, shared.value)
        for batch in batches:
            out: list[tuple[str, float, bool]] = []
            for value in batch["text"]:
                text = value.as_py()
                if model is None or text is None or not letter.search(text):
                    out.append(("und", 0.0, True))
                    continue
                p = model.probabilities(model.logits(text.encode("utf-8", "surrogatepass")))
                k = int(p.argmax())
                out.append((model.langs[k], float(p[k]), bool(p[k] < model.threshold)))
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.array([a for a, _, _ in out], pa.string()), pa.array([b for _, b, _ in out], pa.float64()),
                 pa.array([c for _, _, c in out], pa.bool_())], names=["row", "lang_pred", "score", "rejected"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    schema = T.StructType([packed.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return packed.mapInArrow(run, schema)
