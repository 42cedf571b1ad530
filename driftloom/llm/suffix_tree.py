"""Language model scoring by a probabilistic suffix tree over words.

Symbols are the words of a text, lower-cased in ASCII, then one end. The root is the distribution of single symbols;
deeper states are contexts of one word, two words and so on up to ``DEPTH``. A context is a candidate if it occurs
``LEAST_CONTEXT`` times, a next symbol of it is told from others if it follows ``LEAST_EDGE`` times; the context becomes
a state if the training texts gain at least ``LEAST_GAIN`` in log-likelihood from it over its longest proper suffix
(the count times the divergence of the two). A state's distribution is absolutely discounted and gives what is left
to that of its suffix, so each is a proper distribution. A symbol is scored by the longest state that ends its past.

All bounds are counts, so the tree grows with the corpus. Contexts that end in one word, and what follows them, are in one part, as are
their suffixes: a part's places in the texts make its part of the tree without another shuffle, and the texts to be scored meet it there. A
place travels as the codes of its symbol and of the words before it, packed by part; to be scored, only with the words that a state may have (a filter of
bits tells; a wrong bit only makes work). What returns is a sum for each document and task. The contexts of a
hot word (or of a hot run of words) are dealt over several parts by the word before; its own distribution is counted first and
given to these. So cost and space grow with the texts, and a task holds one part. Only a run of four words is not dealt further: equal places of it are summed up.
Executors have the ``MOST_WORDS`` most frequent words at hand; others travel as hashes, and their counts are joined.

Words are told apart by 64-bit hashes alone.

Cases: a null or empty text is its end alone; rows without an id are training rows; repeated rows count and are scored
each; without any training text every symbol has the root's probability of an unseen one; an empty table gives an
empty table. Other columns are kept, those named like the output are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import LOWER, Block, Lookup, SpanHasher, Tables, blocks, checkpointed, mixed, others, release, remove_folder, unused

#: Words of the longest context; taken off each count of a next symbol.
DEPTH, DISCOUNT = 4, 0.75
LEAST_CONTEXT, LEAST_EDGE, LEAST_GAIN = 20, 3, 8.0
#: Words (below 2^24) and entries of the tree that a task has at hand.
MOST_WORDS, MOST_ENTRIES = 1 << 19, 1 << 22
#: Bits of the filter of states (a power of two); it is an eighth as many bytes.
FILTER_BITS = 1 << 26
#: The hash that stands for the end of a text, and keys that a task sums up before it hands them on.
END = np.uint64(0x0D15EA5E0DDBA115)
HELD = 1 << 21
MADE = ("n_tokens", "n_known", "train_tokens", "base_score", "score")

_STEP = np.uint64(0x9E3779B97F4A7C15)


def symbols(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of the text of each symbol, text by text, each with its end."""
    starts, ends, text = block.words()
    hashed = SpanHasher(LOWER[block.data])(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    counts = np.bincount(text, minlength=block.n) + 1
    stop = np.cumsum(counts)
    out = np.full(stop[-1], END) if block.n else np.zeros(0, np.uint64)
    inner = np.ones(len(out), bool)
    inner[stop - 1] = False
    out[inner] = hashed
    return out, np.repeat(np.arange(block.n), counts)


class Runs:
    """The runs of symbols of a block: ``run(k)`` has the hashes of the k symbols up to each place, ``whole(k)`` the
    places where these are in one text."""

    def __init__(self, hashes: np.ndarray, owner: np.ndarray):
        self.hashes, self.owner = hashes, owner
        new = np.ones(len(owner), bool)
        new[1:] = owner[1:] != owner[:-1]
        begin = np.flatnonzero(new)
        self.place = np.arange(len(owner)) - np.repeat(begin, np.diff(np.append(begin, len(owner))))
        self.made = [np.zeros(len(hashes), np.uint64), hashes]

    def run(self, k: int) -> np.ndarray:
        while len(self.made) <= k:
            last = self.made[-1]
            longer = np.zeros(len(last), np.uint64)
            longer[1:] = mixed(last[:-1] * _STEP + self.hashes[1:])
            self.made.append(longer)
        return self.made[k]

    def whole(self, k: int) -> np.ndarray:
        return np.flatnonzero(self.place >= k - 1)


def _summed(keys: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Counts of 64-bit keys, summed up to about HELD keys at a time."""
    key, n, size, held = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, []

    def merge() -> tuple[np.ndarray, np.ndarray]:
        fresh = np.sort(np.concatenate(held)) if held else key[:0]
        first = np.flatnonzero(np.append(True, fresh[1:] != fresh[:-1])) if len(fresh) else np.zeros(0, np.int64)
        every = np.concatenate([key, fresh[first]])
        order = np.argsort(every, kind="stable")  # two sorted runs, which are merged
        every, weight = every[order], np.concatenate([n, np.diff(np.append(first, len(fresh)))])[order]
        edge = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
        return every[edge], np.add.reduceat(weight, edge) if len(edge) else weight

    for k in keys:
        held.append(k)
        size += len(k)
        if size >= HELD:
            key, n = merge()
            held, size = [], 0
            if len(key) > HELD:
                yield key, n
                key, n = key[:0], n[:0]
    if held or len(key):
        yield merge()


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, n): how often each symbol occurs in the column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _summed(symbols(block)[0].view(np.int64) for _, block in blocks(batches, "text")):
            yield pa.record_batch([pa.array(key), pa.array(n)], names=["h", "n"])

    return texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _most(table: DataFrame, most: int, *columns: Column | str) -> tuple[int, pa.Table]:
    """Those rows of the highest counts n that are ``most`` or fewer, and the least count of them (1 for all rows)."""
    by_count = table.groupBy("n").agg(F.count("*").alias("rows")).toArrow().sort_by([("n", "descending")])
    fits = int((np.cumsum(by_count["rows"].to_numpy()) <= most).sum())
    least = 1 if fits == len(by_count) else by_count["n"][fits - 1].as_py() if fits else 1 << 62
    return least, table.filter(F.col("n") >= least).select(*columns).toArrow()


class Words:
    """The most frequent symbols of the training texts, those that executors have at hand, by falling count: ``hashes`` and
    counts ``n``. Others occur less than ``least`` times."""

    def __init__(self, counts: DataFrame):
        self.least, rows = _most(counts, MOST_WORDS, "h", "n")
        order = np.argsort(-rows["n"].to_numpy(), kind="stable")
        self.hashes, self.n = rows["h"].to_numpy().view(np.uint64)[order], rows["n"].to_numpy()[order]
        self.rank = Lookup(self.hashes, np.arange(len(order), dtype=np.int32))
        self.edges, self.contexts = (int((self.n >= least).sum()) for least in (LEAST_EDGE, LEAST_CONTEXT))
        self.table = np.concatenate([np.zeros(2, np.uint64), self.hashes])
        # whether symbols that are not at hand may be next symbols or part of a context
        self.far = self.least > LEAST_EDGE, self.least > LEAST_CONTEXT

    def codes(self, at: np.ndarray, rank: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of n symbols, of which those at ``at`` are at hand, as next symbols and in contexts: rank + 2, 1 if not at
        hand, 0 if too rare."""
        out = []
        for most, far in zip((self.edges, self.contexts), self.far, strict=True):
            code = np.full(n, int(far), np.int32)
            code[at] = np.where(rank < most, rank + 2, 0)
            out.append(code)
        return out[0], out[1]


def part_size() -> int:
    """Places of the training texts in a part: each makes less than eight entries, a next symbol and a state for each of four levels."""
    return max(64, MOST_ENTRIES // 8)


class Filter:
    """Two bits for each hash, named by its leading and its last bits; a wrong bit only makes work."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def places(hashes: np.ndarray) -> np.ndarray:
        return np.stack([hashes >> np.uint64(64 - (FILTER_BITS.bit_length() - 1)), hashes & np.uint64(FILTER_BITS - 1)])

    @staticmethod
    def of_states(entries: DataFrame) -> Filter:
        """The filter of the states' keys; at most FILTER_BITS / 64 pairs of numbers reach the driver."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = np.zeros(FILTER_BITS // 64, np.uint64)
            for b in batches:
                for data in b.column("data"):
                    key, _, states = _unpacked(data.as_py())
                    at = Filter.places(key[len(key) - states :]).ravel()
                    np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
            w = np.flatnonzero(words)
            yield pa.record_batch([pa.array(w), pa.array(words[w].view(np.int64))], names=["w", "b"])

        found = entries.select("data").mapInArrow(run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        words = np.zeros(FILTER_BITS // 64, np.uint64)
        words[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
        return Filter(words)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in Filter.places(hashes):
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)) > 0
        return out


class Parts:
    """Which part a place in a text belongs to: that of the word before it, so that all contexts which end in a word are
    in one part. A hot context (more than ``size`` places) has parts of its own, by the word before it: these hold the contexts
    that are longer than it."""

    def __init__(self, total: int):
        self.size = part_size()
        self.cold = self.n = max(1, -(-total // self.size))
        self.hot: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pairs: list[tuple[int, int, int, bool]] = []  # level, context, part that needs it, whether the part is its own
        self._above: dict[int, list[tuple[int, int]]] = {}

    def add(self, rows: list[tuple[int, int, int | None]]) -> None:
        """The hot contexts (hash, places, hash of the context without its first word) of the next level."""
        level = len(self.hot) + 1
        rows = sorted((h & (1 << 64) - 1, h, n, above) for h, n, above in rows)
        split = np.array([-(-n // self.size) for _, _, n, _ in rows], np.int64)
        base = self.n + np.cumsum(split) - split
        self.n += int(split.sum())
        self.hot.append((np.array([r[0] for r in rows], np.uint64), base, split))
        for (_, h, _, above), b, s in zip(rows, base.tolist(), split.tolist(), strict=True):
            line = self._above[h] = [*(self._above[above] if above is not None else []), (level, h)]
            self.pairs += [(k, c, p, c == h) for p in range(b, b + s) for k, c in line]

    def level(self, part: int) -> int:
        """The words of the shortest contexts that a part holds."""
        return 1 + sum(len(base) > 0 and part >= base[0] for _, base, _ in self.hot)

    def of(self, runs: Runs, at: np.ndarray, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Parts of the places ``at``, and whether they have a context that their part holds."""
        part = (mixed(runs.hashes[at - 1]) % np.uint64(self.cold)).astype(np.int64)
        held, left = np.ones(len(at), bool), np.arange(len(at))
        for k, (keys, base, split) in enumerate(self.hot, 1):
            if not len(keys):
                break
            i, hit = _within(keys, runs.run(k)[at[left] - 1])
            left, i = left[hit], i[hit]
            longer = codes[k + 1][left] != 0
            by = np.where(longer, runs.run(k + 1)[at[left] - 1], runs.hashes[at[left]])
            part[left] = base[i] + (mixed(by) % split[i].astype(np.uint64)).astype(np.int64)
            held[left] = longer
            left = left[longer]
        return part, held


def _within(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the sorted keys have h, and whether they do."""
    i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return i, keys[i] == h


class Places:
    """The places of texts that have a context, as codes: of the next symbol and of the ``depth`` words before it, the
    nearest first, 0 from a word on that is too rare for a context. Packed by part as compressed planes of bytes."""

    def __init__(self, words: Words, parts: Parts, depth: int, states: Filter | None = None):
        self.words, self.parts, self.depth, self.states, self.held, self.size = words, parts, depth, states, [], 0

    def codes(self, runs: Runs, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        symbol, word = self.words.codes(*found, len(runs.hashes))
        codes = [symbol]
        for j in range(1, self.depth + 1):
            c = np.zeros_like(word)
            c[j:] = word[:-j]
            c[runs.place < j] = 0
            if j > 1:
                c[codes[-1] == 0] = 0
            codes.append(c)
        at = np.flatnonzero(codes[1])
        return at, [c[at] for c in codes]

    def add(self, runs: Runs, found: tuple[np.ndarray, np.ndarray], number: np.ndarray | None) -> None:
        """Takes the places of a block; ``number`` has the document of each symbol, if any is to be kept."""
        at, codes = self.codes(runs, found)
        part, held = self.parts.of(runs, at, codes)
        if self.states is not None:
            # words beyond the longest state that a place may have make no difference
            open_ = np.zeros(len(at), bool)
            for k in range(self.depth, 0, -1):
                there = np.flatnonzero(~open_ & (codes[k] != 0))
                open_[there] = self.states.has(state_key(k, runs.run(k)[at[there] - 1]))
                codes[k][~open_] = 0
            at, part, codes = at[open_], part[open_], [c[open_] for c in codes]
        if number is None:
            at, part, codes = at[held], part[held], [c[held] for c in codes]
        far = [runs.hashes[at - j] if self.words.far[j > 0] else None for j in range(self.depth + 1)]
        self.held.append((part, codes, far, None if number is None else number[at].astype(np.int32)))
        self.size += len(runs.hashes)

    def packed(self) -> Iterator[tuple[int, bytes]]:
        """(part, packed places) of all places taken since the last call."""
        if not self.held:
            return
        part = np.concatenate([x[0] for x in self.held])
        if self.held[0][3] is None:  # like beside like
            one, two = (np.concatenate([x[1][j] for x in self.held]) for j in (1, 2))
            order = np.argsort(part << 40 | one.astype(np.int64) << 20 | two.astype(np.int64) & (1 << 20) - 1)
        else:
            order = np.argsort(part.astype(np.uint16) if self.parts.n <= 1 << 16 else part, kind="stable")
        part = part[order]
        columns = [np.concatenate([x[1][j] for x in self.held])[order] for j in range(self.depth + 1)]
        far = [None if self.held[0][2][j] is None else np.concatenate([x[2][j] for x in self.held])[order] for j in range(self.depth + 1)]
        number = None if self.held[0][3] is None else np.concatenate([x[3] for x in self.held])[order]
        self.held, self.size = [], 0
        if not len(part):
            return
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        if number is not None:
            step = np.diff(number, prepend=0)
            step[first] = number[first]
            columns.append(step)
        planes = np.stack([(c >> (8 * b)).astype(np.uint8) for c in columns for b in range(3)])
        codec = pa.Codec("zstd", compression_level=1)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True):
            hashes = [h[a:b][c[a:b] == 1] for c, h in zip(columns, far, strict=False) if h is not None]
            extra = np.concatenate(hashes).tobytes() if hashes else b""
            head = np.array([b - a, len(extra)], np.int64).tobytes()
            yield int(part[a]), head + extra + codec.compress(planes[:, a:b].tobytes(), asbytes=True)


    @staticmethod
    def unpacked(data: bytes, words: Words, depth: int, numbered: bool = False) -> tuple[np.ndarray, list[np.ndarray], np.ndarray | None]:
        """(codes of the next symbols, hashes of these and of the words before them or 0, documents if ``numbered``)."""
        n, size = np.frombuffer(data, np.int64, 2).tolist()
        columns = depth + 1 + numbered
        raw = pa.Codec("zstd").decompress(memoryview(data)[16 + size :], 3 * columns * n, asbytes=True)
        planes = np.frombuffer(raw, np.uint8).reshape(columns, 3, n).astype(np.int32)
        codes = planes[:, 0] | planes[:, 1] << 8 | planes[:, 2] << 16
        far, used, hashes = np.frombuffer(data, np.uint64, size // 8, 16), 0, []
        for j in range(depth + 1):
            h = words.table[codes[j]]
            if words.far[j > 0]:
                open_ = np.flatnonzero(codes[j] == 1)
                h[open_] = far[used : used + len(open_)]
                used += len(open_)
            hashes.append(h)
        return codes[0], hashes, np.cumsum(codes[-1]) if numbered else None


def _pieces(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Cuts batches where the sorted column ``by`` changes."""
    for batch in batches:
        value = batch.column(by).to_numpy()
        cuts = [0, *(np.flatnonzero(value[1:] != value[:-1]) + 1).tolist(), len(value)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield int(value[a]), batch.slice(a, b - a)


def _chain(hashes: list[np.ndarray], k: int, last: int, at: np.ndarray) -> np.ndarray:
    """Hash of the run from the k-th word before a symbol to the ``last``-th, as ``Runs`` makes it."""
    x = hashes[k][at]
    for j in range(k - 1, last - 1, -1):
        x = mixed(x * _STEP + hashes[j][at])
    return x


def _numbered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different value, and the number of the value at each place."""
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


class Tree:
    """``total`` and ``distinct`` symbols of the training texts, ``counts`` of each (h, n), and ``entries``: packed keys and values by (part, kind, data). Of the next symbols of states the value is the log10 of how much likelier they are
    than by the root, of states that of what they leave to their suffixes. ``words`` and ``parts`` deal texts to the entries."""

    def __init__(self, counts: DataFrame, total: int, distinct: int, depth: int):
        self.counts, self.total, self.distinct, self.depth = counts, total, distinct, depth
        self.words, self.parts, self.entries = Words(counts), Parts(total), None

    @property
    def unseen(self) -> float:
        """Log10 of what divides the smoothed counts of the root."""
        return math.log10(self.total + 0.5 * (self.distinct + 1))


def edge_key(k: int, run: np.ndarray) -> np.ndarray:
    """Keys of next symbols after contexts of k, by the hashes of both."""
    return mixed(run + np.uint64(2 * k))


def state_key(k: int, run: np.ndarray) -> np.ndarray:
    return mixed(run + np.uint64(2 * k + 1))


def _hot_pass(texts: DataFrame, tree: Tree, shared, k: int) -> DataFrame:
    """(what, g, context, suffix, n) of the hot contexts of k words: 0 for runs that end in a next symbol, 1 for the contexts that are a
    word longer (suffix: the hot one); for k = 1, 2 for symbols g that are not at hand in the cold part ``context``."""
    depth = tree.depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, parts = shared.value
        hot, places = parts.hot[k - 1][0], Places(words, parts, depth)
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def rows() -> pa.RecordBatch:
            what, g, context, suffix = (np.concatenate(x) for x in zip(*held, strict=True))
            first, number = _numbered(mixed(g + what.astype(np.uint64)) + np.where(what == 2, mixed(context), np.uint64(0)))
            columns = [what[first].astype(np.int8), *[x[first].view(np.int64) for x in (g, context, suffix)], np.bincount(number, minlength=len(first)).astype(np.int64)]
            return pa.record_batch([pa.array(x) for x in columns], names=["what", "g", "context", "suffix", "n"])

        for _, block in blocks(batches, "text"):
            runs = Runs(*symbols(block))
            at, codes = places.codes(runs, words.rank.find(runs.hashes))
            there = codes[k] != 0
            ctx = runs.run(k)[at[there] - 1]
            inside = _within(hot, ctx)[1] if len(hot) else np.zeros(len(ctx), bool)
            p, ctx, next_ = at[there][inside], ctx[inside], [c[there][inside] for c in codes]
            edge, longer = next_[0] != 0, next_[k + 1] != 0
            held.append((np.zeros(int(edge.sum()), np.int64), runs.run(k + 1)[p[edge]], ctx[edge], runs.run(k)[p[edge]]))
            held.append((np.ones(int(longer.sum()), np.int64), runs.run(k + 1)[p[longer] - 1], ctx[longer], ctx[longer]))
            if k == 1 and words.far[0]:
                far = np.flatnonzero(codes[0] == 1)
                part, cold = parts.of(runs, at[far], [c[far] for c in codes])
                cold = part < parts.cold
                h = runs.hashes[at[far]][cold]
                held.append((np.full(len(h), 2), h, part[cold].astype(np.uint64), np.zeros(len(h), np.uint64)))
            size += sum(len(x[0]) for x in held[-3:])
            if size >= HELD:
                yield rows()
                held.clear()
                size = 0
        if held:
            yield rows()

    found = texts.mapInArrow(run, "what byte, g long, context long, suffix long, n long")
    return found.groupBy("what", "g", F.when(F.col("what") == 2, F.col("context")).otherwise(0).alias("part")).agg(F.min("context").alias("context"), F.min("suffix").alias("suffix"), F.sum("n").alias("n"))


def fit(texts: DataFrame, counts: DataFrame, depth: int = DEPTH) -> Tree:
    """The tree of the column text, given the counts of its symbols; ``depth`` is 2 or more."""
    spark = texts.sparkSession
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tree = Tree(counts, total, distinct, depth)
    tables = Tables(spark, "suffix-tree")
    root = (F.col("n") + 0.5) / F.lit(10**tree.unseen)
    known = counts.filter(F.col("n") >= LEAST_EDGE).select(F.col("h").alias("g"), root.alias("q"), root.alias("root"))
    # at most total / size rows of each level reach the driver
    hot = counts.filter((F.col("n") > tree.parts.size) & (F.col("h") != F.lit(int(END.view(np.int64))))).select("h", "n", F.lit(None).cast("long").alias("above"))
    levels, given = [], []
    for k in range(1, depth):
        tree.parts.add([tuple(r) for r in hot.collect()])
        if not len(tree.parts.hot[-1][0]) and not (k == 1 and tree.words.far[0]):
            break
        shared = spark.sparkContext.broadcast((tree.words, tree.parts))
        found = tables.write(_hot_pass(texts, tree, shared, k))
        if k == 1 and tree.words.far[0]:
            given.append(found.filter("what = 2").select(F.col("part").cast("int").alias("part"), F.col("g").alias("h")).join(counts.filter(F.col("n") >= LEAST_EDGE), "h").select("part", F.lit(0).cast("byte").alias("kind"), "h", root.alias("x"), root.alias("y")))
        if not len(tree.parts.hot[-1][0]):
            break
        edges = found.filter((F.col("what") == 0) & (F.col("n") >= LEAST_EDGE)).select("g", "context", "suffix", "n")
        runs = edges.join(known.select(F.col("g").alias("suffix"), F.col("q").alias("low"), "root"), "suffix")
        runs = tables.write(runs.join(F.broadcast(hot.select(F.col("h").alias("context"), F.col("n").alias("often"))), "context"))
        states = tables.write(_tested(runs))
        share = (F.col("n") - DISCOUNT) / F.col("often")
        q = F.when(F.col("rest").isNotNull(), share + F.col("rest") * F.col("low")).otherwise(F.col("low"))
        known = tables.write(runs.join(states.select("context", "rest"), "context", "left").select("g", "context", q.alias("q"), "root", F.col("rest").isNotNull().alias("edge")))
        levels.append((known, states))
        hot = tables.write(found.filter((F.col("what") == 1) & (F.col("n") > tree.parts.size)).select(F.col("g").alias("h"), "n", F.col("suffix").alias("above")))
    if tree.parts.pairs:
        columns = zip(*tree.parts.pairs, strict=True)
        pairs = F.broadcast(spark.createDataFrame(pa.table([pa.array(x) for x in columns], names=["level", "context", "part", "own"])).withColumn("part", F.col("part").cast("int")))
    entries = []
    for k, (known, states) in enumerate(levels, 1):
        mine = pairs.filter(F.col("level") == k)
        given.append(known.join(mine.filter("own"), "context").select("part", F.lit(1).cast("byte").alias("kind"), F.col("g").alias("h"), F.col("q").alias("x"), F.col("root").alias("y")))
        edges = known.filter("edge").select("context", F.col("g").alias("h"), F.lit(False).alias("state"), F.log10(F.col("q") / F.col("root")).alias("x"))
        both = edges.union(states.select("context", F.col("context").alias("h"), F.lit(True), F.log10("rest")))
        entries.append(_keyed(both, k).join(mine, "context").select("part", "kind", "data"))
    shared = spark.sparkContext.broadcast((tree.words, tree.parts))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_places(texts, tree, shared), *given])
    grown = _grown(rows.repartition(_tasks(spark, tree.parts), "part").sortWithinPartitions("part", "kind"), tree, shared)
    tree.entries = checkpointed(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [grown, *entries]))
    remove_folder(spark, tables.folder)
    return tree


def _tasks(spark: SparkSession, parts: Parts) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts.n // 4)


def _entries(key: np.ndarray, value: np.ndarray, states: int) -> bytes:
    """Packed keys and values, of which the last ``states`` are those of states."""
    return np.array([len(key), states], np.int64).tobytes() + key.tobytes() + value.tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    n, states = np.frombuffer(data, np.int64, 2).tolist()
    return np.frombuffer(data, np.uint64, n, 16), np.frombuffer(data, np.float64, n, 16 + 8 * n), states


def _keyed(rows: DataFrame, k: int) -> DataFrame:
    """(context, kind, data): the packed entries of each context of level k."""

    def run(group: pa.Table) -> pa.Table:
        h, x = group["h"].to_numpy().view(np.uint64), group["x"].to_numpy()
        state = group["state"].to_numpy()
        key = np.concatenate([edge_key(k, h[~state]), state_key(k, h[state])])
        data = _entries(key, np.concatenate([x[~state], x[state]]), int(state.sum()))
        return pa.table({"context": group["context"][:1], "kind": pa.array([1], pa.int8()), "data": pa.array([data], pa.binary())})

    return rows.select("context", "h", "state", "x").groupBy("context").applyInArrow(run, "context long, kind byte, data binary")


def _places(texts: DataFrame, tree: Tree, shared) -> DataFrame:
    """(part, kind, data): the places of the training texts."""
    depth = tree.depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, parts = shared.value
        places = Places(words, parts, depth)

        def rows() -> Iterator[pa.RecordBatch]:
            if made := list(places.packed()):
                part, data = zip(*made, strict=True)
                yield pa.record_batch([pa.array(part, pa.int32()), pa.array(np.full(len(part), 2, np.int8)), pa.array(data, pa.binary())], names=["part", "kind", "data"])

        for _, block in blocks(batches, "text"):
            runs = Runs(*symbols(block))
            places.add(runs, words.rank.find(runs.hashes), None)
            if places.size >= HELD // 2:
                yield from rows()
        yield from rows()

    return texts.mapInArrow(run, "part int, kind byte, data binary")


def _grown(rows: DataFrame, tree: Tree, shared) -> DataFrame:
    """(part, kind, data): the packed entries of each part, from its places and what it is given of roots and hot contexts."""
    depth, scale = tree.depth, 10**tree.unseen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, parts = shared.value
        now, given, held, size = None, [], [], 0

        def merged() -> list[np.ndarray]:
            every = [np.concatenate(x) for x in zip(*held, strict=True)]
            first, number = _numbered(_chain(every[:-2], depth, 0, np.arange(len(every[0]))))
            return [x[first] for x in every[:-1]] + [np.bincount(number, every[-1], len(first))]

        def rows() -> Iterator[pa.RecordBatch]:
            if held:
                *hashes, root, weight = (np.concatenate(x) for x in zip(*held, strict=True))
                low, level = root, parts.level(now)
                if level > 1:
                    # what is known of the hot context
                    low, root = np.zeros(len(root)), root.copy()
                    h, x, y = (np.concatenate(v) for v in zip(*given, strict=True)) if given else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
                    at, i = Lookup(h.view(np.uint64), np.arange(len(h))).find(_chain(hashes, level - 1, 0, np.arange(len(root))))
                    low[at], root[at] = x[i], y[i]
                key, value, states = _subtree(hashes, root, low, weight, level, depth)
                if len(key):
                    data = _entries(key, value, states)
                    yield pa.record_batch([pa.array([now], pa.int32()), pa.array([1], pa.int8()), pa.array([data], pa.binary())], names=["part", "kind", "data"])

        for part, piece in _pieces(batches, "part"):
            if part != now:
                yield from rows()
                now, given, held, size, far = part, [], [], 0, None
            kind = piece.column("kind").to_numpy()
            small = pa.array(kind < 2)
            if (kind < 2).any():
                given.append(tuple(piece.column(c).filter(small).to_numpy(zero_copy_only=False) for c in ("h", "x", "y")))
            for data in piece.column("data").filter(pa.array(kind == 2)):
                code, hashes, _ = Places.unpacked(data.as_py(), words, depth)
                root = np.zeros(len(code))
                near = code >= 2
                root[near] = (words.n[code[near] - 2] + 0.5) / scale
                if words.far[0] and part < parts.cold and given:
                    if far is None:
                        far = Lookup(np.concatenate([g[0] for g in given]).view(np.uint64), np.concatenate([g[1] for g in given]))
                    open_ = np.flatnonzero(code == 1)
                    at, x = far.find(hashes[0][open_])
                    root[open_[at]] = x
                held.append((*hashes, root, np.ones(len(code))))
                size += len(code)
                if size >= 2 * HELD:
                    held = [tuple(merged())]
                    size = len(held[0][0])
        yield from rows()

    return rows.mapInArrow(run, "part int, kind byte, data binary")


def _subtree(hashes: list[np.ndarray], root: np.ndarray, low: np.ndarray, weight: np.ndarray, level: int, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys and values of the contexts of ``level`` words and more, last those of states, and how many these are. ``low`` has the probability of each symbol by the tree so far, 0
    where it is no next symbol of the shorter context."""
    keys, values, states, rests = [np.zeros(0, np.uint64)], [np.zeros(0)], [np.zeros(0, np.uint64)], [np.zeros(0)]
    at = np.flatnonzero(hashes[level])
    low = low[at]
    for k in range(level, depth + 1):
        # candidates, and the places that have one
        first, context = _numbered(_chain(hashes, k, 1, at))
        often = np.bincount(context, weight[at], len(first))
        stays = often[context] >= LEAST_CONTEXT
        at, low, context = at[stays], low[stays], context[stays]
        if not len(at):
            break
        some = np.flatnonzero(low > 0)
        run = _chain(hashes, k, 0, at[some])
        first, edge = _numbered(run)
        n = np.bincount(edge, weight[at[some]], len(first))
        kept = n >= LEAST_EDGE
        one = some[first[kept]]
        n, c, q, run, base = n[kept], context[one], low[one], run[first[kept]], root[at[one]]
        share = (n - DISCOUNT) / often[c]
        rest = 1 - np.bincount(c, share, len(often))
        gain = np.bincount(c, n * np.log((share + rest[c] * q) / q), len(often))
        gain += np.maximum(often - np.bincount(c, n, len(often)), 0) * np.log(rest)
        has = np.bincount(c, minlength=len(often)) > 0
        state = has & (gain >= LEAST_GAIN)
        q = np.where(state[c], share + rest[c] * q, q)
        keys.append(edge_key(k, run[state[c]]))
        values.append(np.log10(q[state[c]] / base[state[c]]))
        which = np.full(len(often), -1)
        which[context] = np.arange(len(context))
        which = which[state]
        states.append(state_key(k, _chain(hashes, k, 1, at[which])))
        rests.append(np.log10(rest[state]))
        if k < depth:
            of = np.zeros(len(kept))
            of[kept] = q
            low = np.zeros(len(at))
            low[some] = of[edge]
            longer = hashes[k + 1][at] != 0
            at, low = at[longer], low[longer]
    return np.concatenate(keys + states), np.concatenate(values + rests), sum(map(len, states))


def _tested(runs: DataFrame) -> DataFrame:
    """(context, often, rest) of the contexts of ``runs`` that become states."""
    runs = runs.withColumn("share", (F.col("n") - DISCOUNT) / F.col("often"))
    sums = runs.groupBy("context").agg((1 - F.sum("share")).alias("rest"), F.sum("n").alias("seen"), F.min("often").alias("often"))
    gain = F.col("n") * F.log((F.col("share") + F.col("rest") * F.col("low")) / F.col("low"))
    gains = runs.select("context", "n", "share", "low").join(sums, "context").groupBy("context").agg(F.sum(gain).alias("gain"), F.min("rest").alias("rest"), F.min("seen").alias("seen"), F.min("often").alias("often"))
    lost = F.greatest(F.col("often") - F.col("seen"), F.lit(0)) * F.log("rest")
    return gains.filter(F.col("gain") + lost >= LEAST_GAIN).select("context", "often", "rest")



def _gained(hashes: list[np.ndarray], entries: Lookup, depth: int) -> np.ndarray:
    """How much likelier than by the root the symbols are by the longest state of the entries, as log10."""
    gained, open_ = np.zeros(len(hashes[0])), np.ones(len(hashes[0]), bool)
    for k in range(depth, 0, -1):
        left = np.flatnonzero(open_ & (hashes[k] != 0))
        context = _chain(hashes, k, 1, left)
        hit, value = entries.find(state_key(k, context))
        # next symbols are looked up after states only
        left, context = left[hit], context[hit]
        found, more = entries.find(edge_key(k, mixed(context * _STEP + hashes[0][left])))
        value[found] = more
        gained[left] += value
        open_[left[found]] = False
    return gained


def _lists(values: pa.Array, owner: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)), values)


def _packed_sums(number: np.ndarray, sums: np.ndarray) -> bytes:
    """Rising numbers and sums, as compressed planes of bytes; sums in units of 2^-40."""
    values = np.stack([np.diff(number, prepend=0).astype(np.int64), np.rint(sums * 2.0**40).astype(np.int64)])
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(2, -1, 8).transpose(0, 2, 1))
    return np.int64(len(number)).tobytes() + pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def _unpacked_sums(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    raw = pa.Codec("zstd").decompress(memoryview(data)[8:], 16 * n, asbytes=True)
    step, units = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(2, 8, n).transpose(0, 2, 1)).view(np.int64).reshape(2, n)
    return np.cumsum(step), units / 2.0**40


def score(docs: DataFrame, tree: Tree, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (all columns, or those in ``keep``) with n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    names = [c for c in others(docs, *MADE) if keep is None or c in keep]
    there = unused("there", docs)
    kept = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.struct(F.lit(True).alias(there), *[F.col(f"`{c}`") for c in names]).alias("kept"))
    doc = StructType.fromDDL("n_known long, rare array<long>, n_tokens long, base_score double, score double")
    doc = StructType([StructField("flush", LongType()), StructField("number", IntegerType()), StructField("kept", kept.schema["kept"].dataType), *doc.fields])
    moved = StructType([*StructType.fromDDL("part int, kind byte, data binary").fields, *doc.fields])
    shared = spark.sparkContext.broadcast((tree.words, tree.parts, Filter.of_states(tree.entries)))
    depth, unseen = tree.depth, tree.unseen

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, parts, states = shared.value
        root = np.log10(words.n + 0.5) - unseen
        places = Places(words, parts, depth, states)
        flush, docs_ = TaskContext.get().partitionId() << 32, 0
        empty = None

        def rows() -> Iterator[pa.RecordBatch]:
            if made := list(places.packed()):
                part, data = zip(*made, strict=True)
                own = [pa.array(part, pa.int32()), pa.array(np.full(len(part), 2, np.int8)), pa.array(data, pa.binary()), pa.array(np.full(len(part), flush))]
                yield pa.record_batch([*own, *[pa.nulls(len(part), t) for t in empty]], names=moved.names)

        for batch, block in blocks(batches, "text"):
            runs = Runs(*symbols(block))
            owner, n = runs.owner, block.n
            at, rank = words.rank.find(runs.hashes)
            base, known = np.zeros(len(owner)), np.zeros(len(owner), bool)
            base[at], known[at] = root[rank], True
            places.add(runs, (at, rank), owner + docs_)
            rare = np.flatnonzero(~known)
            total = np.bincount(owner, base, n)
            columns = [
                pa.array(np.arange(docs_, docs_ + n, dtype=np.int32)),
                batch.column("kept"),
                pa.array(np.bincount(owner[known], minlength=n).astype(np.int64)),
                _lists(pa.array(runs.hashes[rare].view(np.int64)), owner[rare], n),
                pa.array(np.bincount(owner, minlength=n).astype(np.int64)),
                pa.array(total),
                pa.array(total),
            ]
            empty = [c.type for c in columns]
            own = [pa.array(np.full(n, (flush + (flush >> 32)) % parts.n, np.int32)), pa.array(np.full(n, 3, np.int8)), pa.nulls(n, pa.binary()), pa.array(np.full(n, flush))]
            yield pa.record_batch([*own, *columns], names=moved.names)
            docs_ += n
            if places.size >= HELD // 2:
                yield from rows()
                flush, docs_ = flush + 1, 0
        yield from rows()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, *_ = shared.value
        now, entries, keys, values = None, None, [], []
        # sums of a task's parts, by flush
        held: dict[int, np.ndarray] = {}

        def sums_() -> pa.RecordBatch:
            made = []
            for x in held.values():
                number = np.flatnonzero(x)
                made.append(_packed_sums(number, x[number]))
            own = {"kind": pa.array(np.full(len(made), 2, np.int8)), "data": pa.array(made, pa.binary()), "flush": pa.array(list(held), pa.int64())}
            return pa.record_batch([own[f.name] if f.name in own else pa.nulls(len(made), f.type) for f in schema], names=[f.name for f in schema])

        for part, piece in _pieces(batches, "part"):
            schema = [f for f in piece.schema if f.name != "part"]
            if part != now:
                now, entries, keys, values = part, None, [np.zeros(0, np.uint64)], [np.zeros(0)]
            kind = piece.column("kind").to_numpy()
            for data in piece.column("data").filter(pa.array(kind == 1)):
                key, value, _ = _unpacked(data.as_py())
                keys.append(key)
                values.append(value)
            places = pa.array(kind == 2)
            if (kind == 2).any() and entries is None:
                entries = Lookup(np.concatenate(keys), np.concatenate(values))
                keys, values = [], []
            if (kind == 2).any():
                rows = piece.filter(places)
                for flush, data in zip(rows.column("flush").to_pylist(), rows.column("data"), strict=True):
                    _, hashes, number = Places.unpacked(data.as_py(), words, depth, True)
                    more = np.bincount(number, _gained(hashes, entries, depth))
                    x = held.get(flush, more[:0])
                    if len(x) < len(more):
                        x = np.append(x, np.zeros(len(more) - len(x)))
                    x[: len(more)] += more
                    held[flush] = x
                if sum(map(len, held.values())) > HELD:
                    yield sums_()
                    held.clear()
            if (kind == 3).any():
                yield piece.filter(pa.array(kind == 3)).drop_columns(["part"])
        if held:
            yield sums_()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(0)
        for flush, piece in _pieces(batches, "flush"):
            if flush != now:
                now, total = flush, np.zeros(0)
            kind = piece.column("kind").to_numpy()
            for data in piece.column("data").filter(pa.array(kind == 2)):
                number, more = _unpacked_sums(data.as_py())
                if not len(number):
                    continue
                if number[-1] >= len(total):
                    total = np.append(total, np.zeros(max(number[-1] + 1 - len(total), len(total))))
                total[number] += more
            if (kind == 3).any():
                rows = piece.filter(pa.array(kind == 3)).drop_columns(["kind", "data"])
                number = rows.column("number").to_numpy()
                if number.max() >= len(total):
                    total = np.append(total, np.zeros(number.max() + 1 - len(total)))
                yield rows.set_column(rows.schema.get_field_index("score"), "score", pa.array(rows.column("score").to_numpy() + total[number]))

    dealt = kept.mapInArrow(deal, moved).unionByName(tree.entries, allowMissingColumns=True)
    # sums of the documents of a flush by part, then the documents themselves
    sums = dealt.repartition(_tasks(spark, tree.parts), "part").sortWithinPartitions("part", "kind").mapInArrow(meet, StructType([*moved.fields[1:]]))
    first = sums.repartition("flush").sortWithinPartitions("flush", "kind").mapInArrow(add, doc)
    first = checkpointed(first.select("kept", "n_known", "rare", "n_tokens", "base_score", "score").withColumn("row", F.monotonically_increasing_id()))
    del dealt, sums
    release(spark)

    rare = first.select("row", F.explode("rare").alias("h")).join(tree.counts, "h", "left")
    more = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5) - unseen).alias("base"), F.count("n").alias("seen"))
    base = F.coalesce("base", F.lit(0.0))
    return first.join(more, "row", "left").select(
        *[F.col(f"kept.`{c}`").alias(c) for c in names],
        "n_tokens",
        # without training texts no symbol is known
        (F.col("n_known") + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"),
        F.lit(tree.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + base).alias("base_score"),
        (F.col("score") + base).alias("score"),
    )


def train_and_score(spark: SparkSession, docs: DataFrame, train, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (see ``score``) scored by the tree of its rows for which the condition ``train`` holds."""
    texts = docs.filter(train).select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = checkpointed(word_counts(texts))
    tree = fit(texts, counts)
    release(spark)
    return score(docs, tree, text, keep)
