"""Quality classifier: naive Bayes support vectors.

A text becomes the set of its n-grams of length one to three over two streams of tokens: its lower-cased words and its
words' shapes (runs of letters, capitals, digits and each sign; a word that equals the one before is marked). Each indicator that ``LEAST_TEXTS`` training texts have is scaled by its class log-count ratio, and a linear hinge-loss model is fitted to the
scaled rows by dual coordinate descent. Margins of rows kept out of that fit give the logistic curve that turns
margins into scores.

N-grams are hashed into ``BUCKETS`` features, so the model has a fixed size. It is fitted on at most
``MOST_LABELLED`` labelled texts, drawn by a hash of id and text; scoring reads every text as a whole.

Cases: null and empty texts have no n-gram and score as the bias says; labels that are null or of absent documents
are ignored; several labels of one document count as their maximum; without labels of both kinds every score is the
share of ones (0.5 without labels); repeated rows are learned from once and score alike. Other columns are kept, those named score or predicted
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Block, SpanHasher, blocks, labelled_sample, mixed, others

MOST_LABELLED = 4_000
#: Features (a power of two).
BUCKETS = 1 << 20
ORDER = 3
#: Training texts that must have a feature for it to count.
LEAST_TEXTS = 2
#: Added to counts, bound of the dual variables, sweeps over the rows, share of rows for the logistic curve.
SMOOTHING, COST, SWEEPS, CALIBRATION = 1.0, 0.1, 12, 5
THRESHOLD = 0.3

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[128:] = ord("a")


def _words_and_shapes(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, of their shapes, and the number of the text, word by word."""
    starts, ends, text = block.words()
    if not len(starts):
        none = np.zeros(0, np.uint64)
        return none, none, text
    words = SpanHasher(LOWER[block.data])(starts, ends)
    kind = _CLASS[block.data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[starts] = True
    kept = np.concatenate([np.zeros(1, np.int64), np.cumsum(keep)])
    shapes = SpanHasher(kind[keep])(kept[starts], kept[ends])
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    shapes = np.where(again, shapes ^ np.uint64(0x5BD1E9955BD1E995), shapes)
    return words, shapes, text


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, feature) pairs of a block, sorted."""
    words, shapes, text = _words_and_shapes(block)
    keys = []
    bits = BUCKETS.bit_length() - 1
    for stream, tokens in enumerate((words, shapes)):
        gram = tokens
        for n in range(1, ORDER + 1):
            if n > 1:
                gram = mixed(gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + tokens[n - 1 :])
            whole = text[: len(gram)] == text[n - 1 :]
            feature = mixed(gram[whole] + np.uint64(2 * n + stream)) >> np.uint64(64 - bits)
            keys.append((text[n - 1 :][whole].astype(np.int64) << bits) | feature.astype(np.int64))
    key = np.unique(np.concatenate(keys))
    return key >> bits, key & (BUCKETS - 1)


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, block in blocks(batches, "text"):
        text, feature = features(block)
        cut = np.searchsorted(text, np.arange(block.n + 1))
        rows = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(feature.astype(np.int32)))
        yield pa.record_batch([batch.column("h"), batch.column("label"), rows], names=["h", "label", "features"])


class Model:
    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def margins(self, block: Block) -> np.ndarray:
        text, feature = features(block)
        return np.bincount(text, self.weights[feature], block.n) + self.bias

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def descend(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, float]:
    """Weights of the features (already scaled) and the bias that minimise the regularised hinge loss.

    One dual variable a row is set to its best value in turn; the class with fewer rows has the larger bound."""
    r = np.random.default_rng(5)
    w, bias = np.zeros(BUCKETS), 0.0
    values = [scale[f] / max(1.0, np.sqrt((scale[f] ** 2).sum())) for f in rows]
    norm = np.array([(v * v).sum() + 1.0 for v in values])
    bound = np.where(y > 0, COST * len(y) / (2 * max(1, (y > 0).sum())), COST * len(y) / (2 * max(1, (y < 0).sum())))
    dual = np.zeros(len(y))
    for _ in range(sweeps):
        for i in r.permutation(len(y)):
            f, v = rows[i], values[i]
            gradient = y[i] * (w[f] @ v + bias) - 1
            to = min(max(dual[i] - gradient / norm[i], 0.0), bound[i])
            if to != dual[i]:
                step = (to - dual[i]) * y[i]
                w[f] += step * v
                bias += step
                dual[i] = to
    return w, bias


def _logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve with the least log loss, by Newton steps; the targets are smoothed."""
    ones, zeros = max(1, (y > 0).sum()), max(1, (y < 0).sum())
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum()])
        h = np.array([[(s * margins * margins).sum() + 1e-3, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", most: int = MOST_LABELLED) -> Model:
    """Learn from the texts of ``docs`` that ``labels`` marks (already restricted to training rows)."""
    found = labelled_sample(docs, labels, id, text, label, most, "quality").mapInArrow(_training_rows, "h long, label int, features array<int>").toArrow().combine_chunks()
    y = np.where(found.column("label").to_numpy() > 0, 1, -1)
    lists = found.column("features").combine_chunks() if len(y) else pa.array([], pa.list_(pa.int32()))
    cut, features_ = lists.offsets.to_numpy(), lists.values.to_numpy()
    order = np.argsort(found.column("h").to_numpy(), kind="stable")
    y, rows = y[order], [features_[cut[i] : cut[i + 1]] for i in order.tolist()]
    if len(set(y.tolist())) < 2:
        share = float((y > 0).mean()) if len(y) else 0.5
        return Model(np.zeros(BUCKETS), 0.0, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    aside = np.arange(len(y)) % CALIBRATION == 0

    def ratios(mask: np.ndarray) -> np.ndarray:
        ones, zeros = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for i in np.flatnonzero(mask):
            (ones if y[i] > 0 else zeros)[rows[i]] += 1
        kept = ones + zeros >= LEAST_TEXTS
        ones, zeros = ones + SMOOTHING, zeros + SMOOTHING
        return np.where(kept, np.log((ones / ones[kept].sum()) / (zeros / zeros[kept].sum())), 0.0)

    def fitted(mask: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        scale = ratios(mask)
        w, bias = descend([rows[i] for i in np.flatnonzero(mask)], scale, y[mask])
        return w, bias, scale

    def margin(w: np.ndarray, bias: float, scale: np.ndarray, i: int) -> float:
        v = scale[rows[i]]
        return w[rows[i]] @ v / max(1.0, np.sqrt((v * v).sum())) + bias

    w, bias, scale = fitted(~aside)
    slope, shift = _logistic(np.array([margin(w, bias, scale, i) for i in np.flatnonzero(aside)]), y[aside])
    return NormedModel(w * scale, scale, bias, slope, shift)


class NormedModel(Model):
    """Margins of rows of unit length."""

    def __init__(self, weights: np.ndarray, scale: np.ndarray, bias: float, slope: float, shift: float):
        super().__init__(weights, bias, slope, shift)
        self.square = scale * scale

    def margins(self, block: Block) -> np.ndarray:
        text, feature = features(block)
        length = np.sqrt(np.bincount(text, self.square[feature], block.n))
        return np.bincount(text, self.weights[feature], block.n) / np.maximum(1.0, length) + self.bias


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score and predicted."""
    names = others(docs, "score", "predicted")
    kept = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in blocks(batches, text):
            yield pa.record_batch([*batch.columns, pa.array(model.scores(model.margins(block)))], names=[*names, "score"])

    return kept.mapInArrow(run, f"{schema}, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
