"""Document quality: a regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, revive

FOLDS = 5
#: Statistics are clipped to this size and kept in steps of 1 / STEPS, so that sums of them and of their products are
#: exact integers, whatever the order of rows (up to 10^11 of them).
LIMIT, STEPS = 32.0, 256
#: Log-density differences are calibrated in cells of 1 / CELLS, clipped to this size.
REACH, CELLS = 200.0, 4

#: Byte classes that shares are taken of.
CLASSES = [
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:'\"-()", b"!?", b"#$%&*+=@\\^_`~", b"|<>[]{}/", b"\n",
    bytes(range(128, 256)), b" \t\r\x0b\x0c",
]
MEMBERS = np.zeros((256, len(CLASSES)))
for _k, _c in enumerate(CLASSES):
    MEMBERS[list(_c), _k] = 1
LETTERS = np.zeros(256, bool)
LETTERS[list(CLASSES[0] + CLASSES[1] + CLASSES[8])] = True


def logit(part: float, whole: float) -> float:
    """The share of `part` on a scale that is even about one half, and finite for none and all."""
    return float(np.log((part + 0.5) / (whole - part + 0.5)))


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of a whole text, bounded by LIMIT; null counts as empty.

    Logarithms of sizes, and logits of shares: byte classes, words without a letter, distinct words, adjacent
    repeats, the most frequent word, repeated lines and pairs of words, words that end in a mark; spread of word
    lengths; entropy of bytes.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    words = raw.split()
    m = len(words)
    size = np.fromiter(map(len, words), np.int64, m)
    times = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    # the last byte of a word, and whether it has a letter
    if m:
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(size)
        letters = np.diff(np.concatenate([[0], np.cumsum(LETTERS[flat])])[np.concatenate([[0], ends])])
        marked = int((~LETTERS[flat[ends - 1]]).sum())
        bare, mean, spread = int((letters == 0).sum()), float(size.mean()), float(size.std())
    else:
        bare = marked = 0
        mean = spread = 0.0
    shares = counts[counts > 0] / max(n, 1)
    pairs = len(set(zip(words, words[1:])))
    out = [
        np.log1p(n), np.log1p(m), np.log1p(mean), np.log1p(spread), float(-(shares * np.log2(shares)).sum()),
        *[logit(x, n) for x in counts @ MEMBERS],
        logit(bare, m), logit(marked, m), logit(len(times), m), logit(sum(a == b for a, b in zip(words, words[1:])), max(m - 1, 0)),
        logit(max(times.values(), default=0), m), logit(pairs, max(m - 1, 0)), logit(len(set(lines)), len(lines)), np.log1p(n / max(len(lines), 1)),
    ]
    return np.clip(np.array(out, np.float64), -LIMIT, LIMIT)


WIDTH = len(statistics(""))
UPPER = np.triu_indices(WIDTH)


def moments(x: np.ndarray) -> np.ndarray:
    """Number, sums and sums of products of rows in steps, as integers."""
    q = np.rint(x * STEPS).astype(np.int64)
    return np.concatenate([[len(q)], q.sum(axis=0), (q.T @ q)[UPPER]])


def shrinkage(s: np.ndarray, n: int) -> float:
    """The weight of a multiple of the identity that approximates the oracle's, from a covariance and its number of rows."""
    d = len(s)
    t, t2 = float(np.trace(s)), float((s * s).sum())
    whole = (n + 1 - 2 / d) * (t2 - t * t / d)
    return 1.0 if whole <= 0 else float(min(1.0, ((1 - 2 / d) * t2 + t * t) / whole))


class Model:
    """Per class a mean and the Cholesky factor of a shrunken covariance, both of standardised statistics; and a
    calibration of the difference of log densities."""

    def __init__(self, sums: np.ndarray):
        """`sums[y]`: the moments of class y; both classes have rows."""
        n = sums[:, 0].astype(float)
        mean = sums[:, 1:1 + WIDTH] / n[:, None] / STEPS
        second = np.zeros((2, WIDTH, WIDTH))
        for y in (0, 1):
            second[y][UPPER] = sums[y, 1 + WIDTH:] / n[y] / STEPS**2
            second[y] = np.triu(second[y]) + np.triu(second[y], 1).T
        cov = second - mean[:, :, None] * mean[:, None, :]
        pooled = np.tensordot(n / n.sum(), cov, 1)
        self.centre = n @ mean / n.sum()
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 0) + 1e-4)
        unit = np.outer(self.scale, self.scale)
        self.mean = (mean - self.centre) / self.scale
        self.factor, self.constant = [], []
        for y in (0, 1):
            # a class of few rows leans on the pooled covariance, and both on a sphere
            own = n[y] / (n[y] + WIDTH)
            s = (own * cov[y] + (1 - own) * pooled) / unit
            rho = max(shrinkage(s, int(n[y])), 1e-3)
            s = (1 - rho) * s + rho * np.trace(s) / WIDTH * np.eye(WIDTH) + 1e-6 * np.eye(WIDTH)
            low = np.linalg.cholesky(s)
            self.factor.append(np.linalg.inv(low))
            self.constant.append(float(-np.log(np.diag(low)).sum()))
        self.slope, self.shift = 1.0, float(np.log(n[1] / n[0]))

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, by Mahalanobis distances."""
        z = (x - self.centre) / self.scale
        far = [((z - self.mean[y]) @ self.factor[y].T) for y in (0, 1)]
        density = [self.constant[y] - 0.5 * (far[y] ** 2).sum(axis=1) for y in (0, 1)]
        return np.clip(density[1] - density[0], -REACH, REACH)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -500, 500)))


class Even:
    """Where one class only, or none, is known: its share."""

    def __init__(self, n: np.ndarray):
        self.share = float((n[1] + 1) / (n.sum() + 2))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def calibrate(z: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through counts n[:, y] at differences z; both are drawn weakly to 1 and 0."""
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -500, 500)))
        whole = n.sum(axis=1)
        w, r = whole * p * (1 - p), whole * p - n[:, 1]
        hess = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1]])
        da, db = np.linalg.solve(hess, [(r * z).sum() + a - 1, r.sum() + b])
        a, b = a - float(np.clip(da, -0.5, 0.5)), b - float(np.clip(db, -1, 1))
        if abs(da) + abs(db) < 1e-9:
            break
    return float(np.clip(a, 0.01, 10)), float(b)


def by_batch(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([statistics(t.as_py()) for t in batch["text"]]).reshape(-1, WIDTH)


def labelled_statistics(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str) -> DataFrame:
    """(y, fold, x) of every labelled document; texts are turned into statistics before anything is joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = by_batch(batch)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * WIDTH, pa.int32()), pa.array(x.ravel()))], names=["id", "x"])

    known = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([known.schema["id"], T.StructField("x", T.ArrayType(T.DoubleType()))])
    marks = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).alias("y"))
    return known.mapInArrow(run, schema).join(marks, "id").select(F.col("y").cast("int").alias("y"), F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int").alias("fold"), "x")


def fit(rows: DataFrame):
    """A model from all of `rows` (y, fold, x): one pass for the moments of each class and fold, one for counts of
    differences by models that have not seen the row's fold. Only these sums reach the driver."""

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 * FOLDS, 1 + WIDTH + len(UPPER[0])), np.int64)
        for batch in batches:
            x, cell = matrix(batch), batch["y"].to_numpy() * FOLDS + batch["fold"].to_numpy()
            for k in np.unique(cell):
                total[k] += moments(x[cell == k])
        cell, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(at), pa.array(total[cell, at])], names=["cell", "at", "v"])

    total = np.zeros((2, FOLDS, 1 + WIDTH + len(UPPER[0])), np.int64)
    for r in rows.mapInArrow(sums, "cell long, at long, v long").groupBy("cell", "at").agg(F.sum("v").alias("v")).collect():
        total[r["cell"] // FOLDS, r["cell"] % FOLDS, r["at"]] = r["v"]
    whole = total.sum(axis=1)
    if not whole[:, 0].all():
        return Even(whole[:, 0])
    model = Model(whole)
    rest = [whole - total[:, f] for f in range(FOLDS)]
    own = [vars(Model(s)) if s[:, 0].all() else None for s in rest]
    shared = rows.sparkSession.sparkContext.broadcast(own)

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [revive(Model, state) for state in shared.value]
        for batch in batches:
            x, fold, y = matrix(batch), batch["fold"].to_numpy(), batch["y"].to_numpy()
            for f in np.unique(fold):
                if models[f] is not None:
                    z = np.rint(models[f].raw(x[fold == f]) * CELLS).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(z), pa.array(y[fold == f].astype(np.int64))], names=["z", "y"])

    counted = rows.mapInArrow(differences, "z long, y long").groupBy("z").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")).orderBy("z").collect()
    if counted:
        model.slope, model.shift = calibrate(np.array([r["z"] for r in counted]) / CELLS, np.array([[r["n0"], r["n1"]] for r in counted], float))
    shared.unpersist()
    return model


def quality(
    docs: DataFrame, labelled: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", threshold: float = 0.5,
) -> DataFrame:
    """One row per document: `row` (the input), score (0 to 1) and predicted (score >= threshold).

    The discriminant learns from all documents of `labelled` that have a label 0 or 1 in `labels`; of several labels of an id the
    highest counts. Class covariances are shrunken towards the pooled one and towards a sphere; the broadcast model is two vectors
    and two triangular factors. Whole texts are scored. Null and empty texts have the statistics of an empty text;
    very long texts are one row of statistics like others. With labels of one class, or none, the score is the smoothed share of label 1.
    Repeated rows score alike; an empty table gives no rows; columns of the input lie in `row` and cannot clash.
    """
    rows = cut(labelled_statistics(labelled, labels, text, doc_id, label), "statistics")
    model = fit(rows)
    kind = type(model)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = revive(kind, shared.value)
        for batch in batches:
            score = model.score(by_batch(batch))
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["row", "score", "predicted"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    schema = T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return packed.mapInArrow(run, schema)
