"""Language identification by a byte convolutional network.

A text is lower-cased, bytes that are no letters become blanks, and its UTF-8 bytes are cut into windows of fixed
length that cover all of it. The network embeds bytes, runs filters of several widths over a window, takes each
filter's maximum and maps these to languages by a softmax; a text's distribution is the mean of its windows'
distributions weighted by their letters. Training is plain numpy with Adam on the driver.

The network is fitted on the whole texts of a bounded sample: at most ``PER_LANGUAGE`` labelled texts of each language,
drawn by a hash of id and text. Scoring reads every text as a whole.

Cases: a null text, and one without a letter, is ``und`` with score 1; rows whose language is null are not learned
from; equal texts of one id are learned from once; without any labelled row every text is ``und`` with score 0; ties go to the language first in order; repeated
rows are scored alike; an empty table gives an empty table. Other columns are kept, those named lang_pred or score
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import others, slices

#: Bytes of a window, and labelled texts that training takes of each language.
WINDOW, PER_LANGUAGE = 192, 300
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 12, 8
EPOCHS, BATCH, RATE = 6, 64, 0.01
#: Windows scored at a time.
CHUNK = 256
UNDETERMINED = "und"

#: Bytes that are letters of UTF-8 text, others become blanks.
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True
_CLEAN = np.where(_LETTER, np.arange(256), 32).astype(np.uint8)


def windows(text: str) -> np.ndarray:
    """The cleaned bytes of a text, one window a row, the last filled up with blanks."""
    data = _CLEAN[np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)]
    n = max(1, -(-len(data) // WINDOW))
    out = np.full(n * WINDOW, 32, np.uint8)
    out[: len(data)] = data
    return out.reshape(n, WINDOW)


class Network:
    """Parameters by name; forward and backward passes over windows (uint8, one a row)."""

    def __init__(self, languages: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"embed": r.normal(0, 0.3, (256, EMBEDDING)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"filter{w}"] = r.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w * EMBEDDING, FILTERS)).astype(np.float32)
            self.p[f"shift{w}"] = np.zeros(FILTERS, np.float32)
        self.p["out"] = r.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.p["bias"] = np.zeros(len(languages), np.float32)

    def tables(self) -> dict[int, list[np.ndarray]]:
        """For each width and place in the filter, the filters' response to each byte."""
        return {w: [self.p["embed"] @ self.p[f"filter{w}"][k * EMBEDDING : (k + 1) * EMBEDDING] for k in range(w)] for w in WIDTHS}

    def pooled(self, x: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        best = []
        for w in WIDTHS:
            span = x.shape[1] - w + 1
            total = tables[w][0][x[:, :span]]
            for k in range(1, w):
                total += tables[w][k][x[:, k : k + span]]
            best.append(np.maximum(total.max(axis=1) + self.p[f"shift{w}"], 0))
        return np.concatenate(best, axis=1)

    def probabilities(self, x: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        return _softmax(self.pooled(x, tables) @ self.p["out"] + self.p["bias"])

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        embedded = p["embed"][x]
        hidden, kept = [], []
        for w in WIDTHS:
            span = x.shape[1] - w + 1
            columns = np.concatenate([embedded[:, k : k + span] for k in range(w)], axis=2)
            response = columns @ p[f"filter{w}"]
            at = response.argmax(axis=1)
            top = np.take_along_axis(response, at[:, None], axis=1)[:, 0] + p[f"shift{w}"]
            hidden.append(np.maximum(top, 0))
            kept.append((columns, at, top > 0))
        h = np.concatenate(hidden, axis=1)
        error = _softmax(h @ p["out"] + p["bias"])
        error[np.arange(n), y] -= 1
        error /= n
        grad = {"out": h.T @ error, "bias": error.sum(0), "embed": np.zeros_like(p["embed"])}
        back = error @ p["out"].T
        rows = np.arange(n)[:, None]
        for i, w in enumerate(WIDTHS):
            columns, at, alive = kept[i]
            d = back[:, i * FILTERS : (i + 1) * FILTERS] * alive
            seen = columns[rows, at]
            grad[f"filter{w}"] = np.einsum("nfc,nf->cf", seen, d)
            grad[f"shift{w}"] = d.sum(0)
            through = np.einsum("nf,cf->nfc", d, p[f"filter{w}"])
            for k in range(w):
                np.add.at(grad["embed"], x[rows, at + k], through[:, :, k * EMBEDDING : (k + 1) * EMBEDDING])
        return grad

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(EPOCHS):
            order = r.permutation(len(x))
            for i in range(0, len(x), BATCH):
                step += 1
                rate = RATE * 0.5**epoch * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                for k, g in self.gradients(x[order[i : i + BATCH]], y[order[i : i + BATCH]]).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.p[k] = (self.p[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _training_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bytes) of all windows of the texts that have letters."""
    for batch in slices(batches, "text"):
        langs, found = [], []
        for t, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            w = windows(t or "")
            for x in w[_LETTER[w].any(axis=1)]:
                langs.append(lang)
                found.append(x.tobytes())
        yield pa.record_batch([pa.array(langs, pa.string()), pa.array(found, pa.binary())], names=["lang", "bytes"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", per_language: int = PER_LANGUAGE) -> Network:
    """Learn from ``docs``, already restricted to training rows."""
    known = docs.filter(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.lit("language"), F.col(id), F.col(text)).alias("h"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # of which Spark keeps the first of each partition
    drawn = known.select("lang", "h").distinct().withColumn("place", place).filter(F.col("place") <= per_language).select("lang", "h")
    drawn = known.join(F.broadcast(drawn), ["lang", "h"]).dropDuplicates(["lang", "h"])
    sample = drawn.select("text", "lang").mapInArrow(_training_windows, "lang string, bytes binary").toPandas().sort_values(["lang", "bytes"])
    languages = sorted(set(sample["lang"]))
    net = Network(languages)
    if languages:
        x = np.frombuffer(b"".join(sample["bytes"]), np.uint8).reshape(-1, WINDOW)
        net.train(x, sample["lang"].map(languages.index).to_numpy(np.int64))
    return net


def identify(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    names = others(docs, "lang_pred", "score")
    kept = docs.select(*[F.col(f"`{c}`") for c in names])
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for batch in slices(batches, text):
            total = np.zeros((batch.num_rows, max(1, len(net.languages))))
            lettered = np.zeros(batch.num_rows, bool)
            held: list[np.ndarray] = []
            owner: list[int] = []

            def flush() -> None:
                if held:
                    x, rows = np.concatenate(held), np.concatenate([np.full(len(h), o) for h, o in zip(held, owner, strict=True)])
                    for i in range(0, len(x), CHUNK):
                        weight = _LETTER[x[i : i + CHUNK]].sum(axis=1)
                        np.add.at(total, rows[i : i + CHUNK], net.probabilities(x[i : i + CHUNK], tables) * weight[:, None])
                    held.clear()
                    owner.clear()

            ready = 0
            for i, t in enumerate(batch.column(text).to_pylist()):
                if t and any(map(str.isalpha, t)):
                    lettered[i] = True
                    if net.languages:
                        held.append(windows(t))
                        owner.append(i)
                        ready += len(held[-1])
                        if ready >= 16 * CHUNK:
                            flush()
                            ready = 0
            flush()
            mass = total.sum(axis=1)
            best = total.argmax(axis=1)
            score = np.where(lettered, total.max(axis=1) / np.maximum(mass, 1e-9), 1.0)
            langs = [net.languages[b] if has and m > 0 else UNDETERMINED for b, has, m in zip(best, lettered, mass, strict=True)]
            yield pa.record_batch([*batch.columns, pa.array(langs, pa.string()), pa.array(np.clip(score, 0.0, 1.0))], names=[*names, "lang_pred", "score"])

    return kept.mapInArrow(run, out)
