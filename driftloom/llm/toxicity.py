"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

Restoring: every word of plain letters reads as it is. All others that have a letter become lattices of characters: words
with digits or signs at, before or among their letters, with a letter three times or more in a row, and letters set
apart by blanks or signs, however many. In a lattice a sign may be a letter that it stands for, noise, or a break between
words; an asterisk any letter; a repeated letter may count once; between letters set apart a word may end; three equal signs or more are emphasis. A Viterbi
search finds the most probable reading under a trigram model of characters with back-off, learned from the labelled
texts. It is linear in the length; readings are settled every ``WINDOW`` characters, so memory is bounded.

Scoring: words and word beginnings of the restored text are looked up among those that the labelled texts tie to
toxicity: kept are features whose log-likelihood ratio against independence is beyond chance for as many features as
are tried, with the lower confidence bound of their precision as weight. A text's score comes from a logistic curve over
the strongest word and the number and rate of strong and weaker ones, fitted on the same labelled rows.

Model and curve are fitted on all labelled texts. Trigrams and features are counted, and the curve's gradients summed, by
Spark; what reaches the driver are the different trigrams, the significant features and a few sums for each step.

Cases: null and empty texts score 0; rows without an id are scored and never held out; labels that are null or of
absent documents are ignored; without labels of both kinds every score is 0; repeated rows are learned from once and
score alike; words of digits and signs alone stay as they are. Other columns are kept, those named score or predicted
are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Block, Lookup, SpanHasher, checkpointed, labelled, others, slices

#: Prefix lengths in bytes; 0 stands for the whole word.
LENGTHS = (0, 4, 5, 6, 7, 8, 9, 10)
#: Least log-likelihood ratio of a feature, and the confidence of its precision in standard deviations.
LEAST_G2, SIGMA = 22.0, 1.64
#: Weight from which a word is strong evidence by itself, and the ridge of the logistic curve.
STRONG, RIDGE = 0.9, 0.5
#: Newton steps at most, and the step that ends them.
STEPS, SETTLED = 40, 1e-10
THRESHOLD = 0.3
#: Characters after which what all readings agree in is put out, remembered spans and their longest.
WINDOW, MEMORY, REMEMBERED = 4096, 50_000, 64
#: Single characters in a row from which they are taken for letters set apart.
APART = 3

# Letters that a digit or sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Signs that may split a word, those that are punctuation as well as letters, and the one that may be any letter.
SPLIT, MARKS, ANY = "-._/~", "!(|+", "*"
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
#: Log costs of a letter as it is, one for a sign, one for an asterisk; of leaving out a repeated letter, a repeated sign, a
#: sign that may be a letter, an asterisk or mark, a splitting sign; of a break at a sign and between letters set apart.
KEEP, STAND, WILD = -0.1, -1.0, -3.5
AGAIN, AGAIN_SIGN, NOISE, STAR, SPLITTING = -0.7, -2.5, -4.0, -1.5, -0.2
BREAK, GAP = -1.0, -0.5
#: Discount of the character model.
DISCOUNT = 0.5

#: Three times the same sign or more: emphasis, at which a word may end.
_EMPHASIS = re.compile(r"([^\w\s])\1\1+")
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTERS[128:] = np.arange(128, 256)


def _bytes_of(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars if ord(c) < 128]] = True
    return out


_SIGN, _SPLIT = _bytes_of("".join(LEET) + ANY), _bytes_of(SPLIT)
_BY_ITSELF = _bytes_of("".join(LEET) + ANY + SPLIT + ALPHABET)


class CharModel:
    """Trigram model of the characters of words; each order is absolutely discounted and backs off to the next shorter
    one, single characters to an even share of the characters seen and one more."""

    def __init__(self, grams: dict[str, int]):
        self.n: Counter[str] = Counter()
        self.total: Counter[str] = Counter()
        self.kinds: Counter[str] = Counter()
        for g, n in grams.items():
            for k in range(3):
                self.n[g[k:]] += n
        for g, n in self.n.items():
            self.total[g[:-1]] += n
            self.kinds[g[:-1]] += 1
        self.known: dict[str, float] = {}
        self.memory: dict[str, str] = {}

    def share(self, gram: str) -> float:
        """The probability of the last character after those before it."""
        if not gram:
            return 1 / (self.kinds[""] + 1)
        past = gram[:-1]
        total = self.total[past]
        shorter = self.share(gram[1:])
        if not total:
            return shorter
        return (max(self.n[gram] - DISCOUNT, 0) + DISCOUNT * self.kinds[past] * shorter) / total

    def cost(self, gram: str) -> float:
        out = self.known.get(gram)
        if out is None:
            if len(self.known) > 500_000:
                self.known.clear()
            out = self.known[gram] = math.log(self.share(gram))
        return out

    def restore(self, span: str) -> str:
        if len(span) > REMEMBERED:
            return self._viterbi(span)[1]
        out = self.memory.get(span)
        if out is None:
            if len(self.memory) > MEMORY:
                self.memory.clear()
            out = self.memory[span] = self._viterbi(span)[1]
        return out

    @staticmethod
    def ways(c: str, before: str) -> list[tuple[str, float]]:
        """What the character c after the character ``before`` may be read as ("" for nothing), with log costs."""
        if c.isalpha():
            return [(c, KEEP), ("", AGAIN)] if c == before else [(c, KEEP)]
        if c in LEET:
            return [*((x, STAND) for x in LEET[c]), ("", STAR if c in MARKS else AGAIN_SIGN if c == before else NOISE)]
        if c == ANY:
            return [*((x, WILD) for x in ALPHABET), ("", STAR)]
        if c == " ":
            return [("", 0.0), (" ", GAP)]
        return [("", SPLITTING if c in SPLIT else 0.0), (" ", BREAK)]

    def step(self, past: str, x: str) -> tuple[str, float]:
        """The last two characters after x is read, and what the model says of it."""
        if not x:
            return past, 0.0
        if x == " ":
            return "^^", self.cost(past + "$") if past != "^^" else 0.0
        return past[1] + x, self.cost(past + x)

    def _viterbi(self, span: str) -> tuple[float, str]:
        """The best reading of all and its score. What all surviving readings have in common is put out as the span goes on."""
        span = _EMPHASIS.sub(" ", span)
        root: list = [None, ""]
        beam: dict[str, tuple[float, list]] = {"^^": (0.0, root)}
        before, out = "", []
        for i, c in enumerate(span):
            if i % WINDOW == 0 and i:
                common = _common([path for _, path in beam.values()])
                out.append(_spelt(common))
                common[:] = None, ""  # all readings now begin there
            ways = self.ways(c, before)
            following: dict[str, tuple[float, list]] = {}
            for past, (score, path) in beam.items():
                for x, cost in ways:
                    to, said = self.step(past, x)
                    s = score + cost + said
                    old = following.get(to)
                    if old is None or s > old[0]:
                        following[to] = (s, [path, x] if x else path)
            beam, before = following, c
        ends = [(s + (self.cost(past + "$") if past != "^^" else 0.0), past, path) for past, (s, path) in beam.items()]
        score, _, path = max(ends, key=lambda e: e[:2])
        return score, "".join([*out, _spelt(path)])


def _common(paths: list[list]) -> list:
    """The last node that all paths go through."""
    line, node = [], paths[0]
    while node is not None:
        line.append(node)
        node = node[0]
    at = {id(n): k for k, n in enumerate(line)}
    deepest = 0
    for node in paths[1:]:
        while id(node) not in at:
            node = node[0]
        deepest = max(deepest, at[id(node)])
    return line[deepest]


def _spelt(path: list | None) -> str:
    out = []
    while path is not None:
        path, x = path
        out.append(x)
    return "".join(reversed(out))


def disguised(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the spans of a block (of lower-cased texts) that become lattices, in order."""
    data = block.data
    starts, ends, text = block.words()
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none
    word = np.zeros(len(data), np.int64)
    word[starts] = 1
    word = np.cumsum(word) - 1
    sign = _SIGN[data]
    for c in LEET:
        raw = np.frombuffer(c.encode(), np.uint8)
        if len(raw) > 1:
            hit = np.ones(max(0, len(data) - len(raw) + 1), bool)
            for k, b in enumerate(raw):
                hit &= data[k : k + len(hit)] == b
            for k in range(len(raw)):
                sign[np.flatnonzero(hit) + k] = True
    letter = (_LETTERS[data] != 32) & ~sign
    again = sign[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & ~((data[2:] >= 48) & (data[2:] <= 57))
    again = np.flatnonzero(again)
    for k in range(3):  # emphasis stands for no letter
        sign[again + k] = False
    side = (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
    split = letter[:-2] & _SPLIT[data[1:-1]] & letter[2:]
    run = letter[:-2] & (data[:-2] == data[1:-1]) & (data[1:-1] == data[2:]) & (data[:-2] < 128)
    flagged = np.zeros(len(starts), bool)
    for marks, reach in ((side, 1), (split, 2), (run, 2)):
        at = np.flatnonzero(marks)
        at = at[(word[at] == word[at + reach]) & (at + reach < ends[word[at]])]
        flagged[word[at]] = True
    # single characters, or one and a splitting sign, in a row
    size = ends - starts
    lone = _BY_ITSELF[data[starts]] & ((size == 1) | ((size == 2) & _SPLIT[data[np.minimum(starts + 1, len(data) - 1)]]))
    edge = np.flatnonzero(np.concatenate([[True], (lone[1:] != lone[:-1]) | (text[1:] != text[:-1]), [True]]))
    long = lone[edge[:-1]] & (np.diff(edge) >= APART)
    first, last = edge[:-1][long], edge[1:][long] - 1
    lettered = np.concatenate([np.zeros(1, np.int64), np.cumsum(letter)])
    some = lettered[ends[last]] - lettered[starts[first]] >= 2
    first, last = first[some], last[some]
    flagged &= ~lone
    low, high = np.concatenate([starts[flagged], starts[first]]), np.concatenate([ends[flagged], ends[last]])
    order = np.argsort(low)
    return low[order], high[order]


def restored(texts: pa.Array, model: CharModel) -> Block:
    """The lower-cased texts with disguised spans read."""
    block = Block(pc.utf8_lower(texts.cast(pa.large_string())))
    low, high = disguised(block)
    if not len(low):
        return block
    raw, pieces, at = block.data.tobytes(), [], 0
    size = np.zeros(len(low), np.int64)
    for i, (a, b) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        new = model.restore(" ".join(raw[a:b].decode().split())).encode()
        size[i] = len(new)
        pieces += (raw[at:a], new)
        at = b
    pieces.append(raw[at:])
    # texts move by what the spans before them grew
    moved = np.concatenate([np.zeros(1, np.int64), np.cumsum(size - (high - low))])
    return Block.of(np.frombuffer(b"".join(pieces), np.uint8), block.offsets + moved[np.searchsorted(low, block.offsets)])


def _features(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: hashes of the words' beginnings, number of the word and of the text."""
    block.data = _LETTERS[block.data]
    starts, ends, text = block.words()
    if not len(starts):
        return
    hashed = SpanHasher(block.data)
    number = np.arange(len(starts))
    for length in LENGTHS:
        if length:
            fits = ends - starts > length
            s = starts[fits]
            yield hashed(s, s + length) ^ np.uint64(length), number[fits], text[fits]
        else:
            yield hashed(starts, ends), number, text


def _count_features(block: Block, toxic: np.ndarray) -> pa.RecordBatch:
    """(feature, a, b): the toxic and other texts with it."""
    keys, labels = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for h, _, text in _features(block):
        pairs = np.unique(np.rec.fromarrays([h, text], names="h,t"))
        keys.append(pairs.h)
        labels.append(toxic[pairs.t])
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    on = np.concatenate(labels)
    return pa.record_batch([pa.array(key.view(np.int64)), pa.array(np.bincount(inverse, on, len(key)).astype(np.int64)), pa.array(np.bincount(inverse, 1 - on, len(key)).astype(np.int64))], names=["feature", "a", "b"])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n) of the words of plain letters."""
    for batch in slices(batches, "text"):
        words = Counter(w for t in batch.column("text").to_pylist() for w in t.lower().split() if w.isalpha())
        grams: Counter[str] = Counter()
        for w, n in words.items():
            padded = f"^^{w}$"
            for i in range(len(w) + 1):
                grams[padded[i : i + 3]] += n
        yield pa.record_batch([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], names=["gram", "n"])


def _xlogy(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(y, 1e-300)), 0.0)


def weigh(a: np.ndarray, b: np.ndarray, toxic: int, other: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood ratio of each feature against independence (0 if it speaks against toxicity), and the lower
    bound of its precision."""
    n, rate = a + b, toxic / (toxic + other)
    p = a / n
    g2 = 2 * (_xlogy(a, p / rate) + _xlogy(b, (1 - p) / (1 - rate)))
    z = SIGMA * SIGMA
    low = (p + z / (2 * n) - SIGMA * np.sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n)
    return np.where(p > rate, g2, 0.0), low


class Model:
    def __init__(self, chars: CharModel, lookup: Lookup, curve: np.ndarray | None = None):
        self.chars, self.lookup, self.curve = chars, lookup, curve

    def summary(self, block: Block) -> np.ndarray:
        """What a text's found words say together: for strong and for weaker words, whether there are any, how many
        and how many of a thousand words; and the strongest weight."""
        n = np.ones(block.n)
        hits = [np.zeros(block.n), np.zeros(block.n)]
        best = np.zeros(block.n)
        words = np.zeros(block.n)
        where, weight, owner = [], [], []
        for h, number, doc in _features(block):
            if not len(where):
                words = np.bincount(doc, minlength=block.n).astype(float)
            at, w = self.lookup.find(h)
            where.append(number[at])
            weight.append(w)
            owner.append(doc[at])
        if where and sum(map(len, where)):
            n_, d, w = np.concatenate(where), np.concatenate(owner), np.concatenate(weight)
            order = np.lexsort((-w, n_))  # the strongest feature of each word
            n_, d, w = n_[order], d[order], w[order]
            first = np.append(True, n_[1:] != n_[:-1])
            d, w = d[first], w[first]
            np.maximum.at(best, d, w)
            hits = [np.bincount(d, w >= STRONG, block.n), np.bincount(d, w < STRONG, block.n)]
        columns = [n, best]
        for k in hits:
            columns += [np.minimum(k, 1), np.log1p(k), np.log1p(1000 * k / (words + 20))]
        return np.stack(columns, axis=1)

    def scores(self, block: Block) -> np.ndarray:
        """A text without any found word scores 0."""
        if self.curve is None:
            return np.zeros(block.n)
        x = self.summary(block)
        return np.where(x[:, 1] > 0, _sigmoid(x @ self.curve), 0.0)

    def score(self, batches: Iterator[pa.RecordBatch], text: str, names: list[str]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield pa.record_batch([*batch.columns, pa.array(self.scores(restored(batch.column(text), self.chars)))], names=[*names, "score"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _moments(beta: np.ndarray):
    """For a step from beta: the sums of the gradient and the curvature over a task's rows (toxic, x, n)."""
    size = len(beta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + size * size)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            y, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("toxic", "n"))
            p = _sigmoid(x @ beta)
            total[:size] += x.T @ (n * (p - y))
            total[size:] += ((x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x).ravel()
        yield pa.record_batch([pa.array([total.tolist()])], names=["sums"])

    return run


def _curve(rows: DataFrame, size: int) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton steps, of the rows (toxic, x, n)."""
    beta = np.zeros(size)
    for _ in range(STEPS):
        parts = [r["sums"] for r in rows.mapInArrow(_moments(beta), "sums array<double>").collect()]
        total = np.array([math.fsum(c) for c in zip(*parts, strict=True)]) if parts else np.zeros(size + size * size)
        g, h = total[:size] + RIDGE * beta, total[size:].reshape(size, size) + RIDGE * np.eye(size)
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        beta = beta - step
        if np.abs(step).max() < SETTLED:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from the texts of ``docs`` that ``labels`` marks (both already restricted to training rows)."""
    rows = labelled(docs, labels, id, text, label).select("text", F.col("label").cast("long").alias("toxic"))
    grams = rows.mapInArrow(_count_grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    chars = CharModel({g: n for g, n in grams.collect()})
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, other = counts.get(1, 0), counts.get(0, 0)
    none = Lookup(np.zeros(0, np.uint64), np.zeros(0))
    if not toxic or not other:
        return Model(chars, none)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield _count_features(restored(batch.column("text"), chars), batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64))

    found = rows.mapInArrow(count, "feature long, a long, b long")
    # twice the logarithm of the rate's inverse is the most that one text can add to the ratio
    least = max(2, math.ceil(LEAST_G2 / (2 * math.log((toxic + other) / toxic))))
    found = found.groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter(F.col("a") >= least)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy().astype(float) for c in ("a", "b"))
            g2, low = weigh(a, b, toxic, other)
            good = (g2 >= LEAST_G2) & (low > max(0.1, 1.5 * toxic / (toxic + other)))
            yield pa.record_batch([batch.column("feature").filter(pa.array(good)), pa.array(low[good])], names=["feature", "low"])

    table = found.filter(F.col("a") * other > F.col("b") * toxic).mapInArrow(judged, "feature long, low double").toArrow().sort_by("feature")
    if not len(table):
        return Model(chars, none)
    model = Model(chars, Lookup(table["feature"].to_numpy().view(np.uint64), table["low"].to_numpy()))
    size = model.summary(Block(pa.array([""]))).shape[1]

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = model.summary(restored(batch.column("text"), chars))
            some = x[:, 1] > 0
            each = pa.FixedSizeListArray.from_arrays(pa.array(x[some].ravel()), size).cast(pa.list_(pa.float64()))
            yield pa.record_batch([batch.column("toxic").filter(pa.array(some)), each], names=["toxic", "x"])

    seen = rows.mapInArrow(summaries, "toxic long, x array<double>").groupBy("toxic", "x").agg(F.count("*").alias("n"))
    # in order, so that sums do not depend on how rows arrive
    seen = checkpointed(seen.sortWithinPartitions("toxic", "x")).coalesce(docs.sparkSession.sparkContext.defaultParallelism)
    model.curve = _curve(seen, size)
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score and predicted."""
    names = others(docs, "score", "predicted")
    kept = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    out = kept.mapInArrow(lambda batches: model.score(batches, text, names), f"{schema}, score double")
    return out.withColumn("predicted", predicted())


def predicted() -> Column:
    return (F.col("score") >= THRESHOLD).cast("int")
