"""Periodic runs in texts: stretches of words that repeat with a period, by a vectorised scan of all lags.

A text's words (``[^\\x20\\x09-\\x0D]+``) become an array of numbers, which is compared with itself shifted by each lag q up
to n / exponent. A stretch of places where both agree, of s places, is a run of s + q words with period q if it is long
enough. Lags are taken in ascending order, and the first lag that finds a stretch (start, length) is its smallest period: a
run's smallest period divides every other period of which it holds two (so those find the same stretch again).

The words of many texts stand in one array, numbered apart, so that no stretch crosses texts; longer texts come first, so
that a lag is compared over the leading part only. A stretch of s places covers one of every s-th places, which are looked
at before stretches are measured.

The comparisons of a text grow with the square of its words. Spark deals ranges of lags of texts that need more than
``WORK`` comparisons over all tasks, as (text, part) rows, and merges what the parts find; other texts are scanned where
they are, without a shuffle.

Cases: a null or empty text has no run and an empty collapsed text; repeated rows get equal results; ids play no part, so
they may be null or repeated; an empty table gives an empty result. Columns of the caller's named ``runs`` or ``collapsed``
(whatever the case) are replaced, all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOCK_BYTES, SPACE_RE, others, unused

#: Comparisons of one text from which its lags are dealt over several tasks, and comparisons of one part.
WORK = 1 << 27
#: Places beside a hit that are looked at before the stretch is measured.
NEAR = 3
RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])
RUNS = T.ArrayType(RUN, False)
FOUND = T.StructType([T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
_RUN = pa.struct([pa.field(c, pa.int64(), False) for c in ("start", "length", "period")])
_RUNS = pa.list_(pa.field("element", _RUN, False))


def _numbered(words: list[bytes], first: int) -> np.ndarray:
    """Equal words get equal numbers, from ``first`` on."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words), first)}
    return np.fromiter(map(number.__getitem__, words), np.int32, len(words))


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each stretch of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).view(np.int8)))
    return edges[::2], edges[1::2] - edges[::2]


def scan(texts: list[list[bytes]], lags: list[tuple[int, int]], least: int, exponent: int) -> list[dict[tuple[int, int], int]]:
    """For each text (its words) the runs whose period is one of its lags low..high-1, as (start, length): period."""
    found: list[dict[tuple[int, int], int]] = [{} for _ in texts]
    size = [len(w) for w in texts]
    reach = [min(high, n // exponent + 1) if n >= least else 0 for n, (_, high) in zip(size, lags, strict=True)]
    order = [i for i in sorted(range(len(texts)), key=lambda i: -reach[i]) if reach[i] > 1]
    if not order:
        return found
    parts, first = [], 0
    for i in order:
        parts.append(_numbered(texts[i], first))
        first += int(parts[-1].max()) - first + 1
    words = np.concatenate(parts)
    ends = np.cumsum([size[i] for i in order])
    low = np.array([lags[i][0] for i in order])
    top = np.array([reach[i] for i in order])
    buffer = np.empty(len(words), bool)
    for q in range(max(1, int(low.min())), int(top[0])):
        m = int(ends[np.searchsorted(-top, -q, "left") - 1])  # texts whose reach is above q
        same = np.equal(words[: m - q], words[q:m], out=buffer[: m - q])
        need = max(least - q, (exponent - 1) * q)
        hits = np.flatnonzero(same[need - 1 :: need])
        if not len(hits):
            continue
        hits = hits * need + need - 1
        near = min(NEAR, (need - 1) // 2)
        ahead = np.ones(len(hits), bool)
        back = ahead.copy()
        for s in range(1, near + 1):  # the longer side of a stretch holds them
            ahead &= same[np.minimum(hits + s, len(same) - 1)] & (hits + s < len(same))
            back &= same[np.maximum(hits - s, 0)] & (hits >= s)
        for k in np.unique(np.searchsorted(ends, hits[ahead | back], "right")):
            if low[k] > q:
                continue
            i = order[k]
            begin = int(ends[k]) - size[i]
            starts, lengths = _stretches(same[begin : max(begin, int(ends[k]) - q)])
            for j in np.flatnonzero(lengths >= need):
                found[i].setdefault((int(starts[j]), int(lengths[j]) + q), q)
    return found


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, without those that a run repeats."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words)


def _blocks(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, words of each text), about BLOCK_BYTES of text at a time."""
    at, held, size = 0, [], 0
    for i, text in enumerate(texts.cast(pa.large_binary())):
        raw = text.as_py() or b""
        held.append(raw.split())  # at the same six characters
        size += len(raw)
        if size >= BLOCK_BYTES:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def _lists(runs: list[list[tuple[int, int, int]]]) -> pa.Array:
    flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
    values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, j])) for j in range(3)], fields=list(_RUN))
    offsets = np.cumsum([0] + [len(own) for own in runs]).astype(np.int32)
    return pa.ListArray.from_buffers(_RUNS, len(runs), [None, pa.py_buffer(offsets)], children=[values])


def _ordered(found: dict[tuple[int, int], int]) -> list[tuple[int, int, int]]:
    return sorted((s, n, q) for (s, n), q in found.items())


def _whole(least: int, exponent: int):
    @F.arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        runs, left = [], []
        for _, words in _blocks(texts):
            own = [_ordered(x) for x in scan(words, [(1, len(w) + 1) for w in words], least, exponent)]
            runs += own
            left += [collapse(w, r) for w, r in zip(words, own, strict=True)]
        return pa.StructArray.from_arrays([_lists(runs), pa.array(left, pa.binary()).cast(pa.string())], ["runs", "collapsed"])

    return find


def _bounds(n: int, part: int, parts: int, exponent: int) -> tuple[int, int]:
    """The lags of one of several parts; each part compares about as many places."""
    most = n // exponent
    # lags 1..x compare x * n - x^2 / 2 places
    share = [int(n - (n * n - 2 * (k / parts) * (most * n - most * most / 2)) ** 0.5) for k in (part, part + 1)]
    return 1 + share[0], most + 1 if part + 1 == parts else 1 + share[1]


def _range(least: int, exponent: int):
    @F.arrow_udf(RUNS)
    def find(texts: pa.Array, part: pa.Array, parts: pa.Array) -> pa.Array:
        out = []
        for at, words in _blocks(texts):
            lags = [_bounds(len(w), part[at + i].as_py(), parts[at + i].as_py(), exponent) for i, w in enumerate(words)]
            out += [_ordered(x) for x in scan(words, lags, least, exponent)]
        return _lists(out)

    return find


@F.arrow_udf(T.StringType())
def _collapsed(texts: pa.Array, runs: pa.Array) -> pa.Array:
    out = []
    for at, words in _blocks(texts):
        out += [collapse(w, [(r["start"], r["length"], r["period"]) for r in runs[at + i].as_py() or []]) for i, w in enumerate(words)]
    return pa.array(out, pa.binary()).cast(pa.string())


def _n_words(text: str, above: int) -> Column:
    """The number of words of texts that can have more than ``above``, 0 for others."""
    return F.when(F.octet_length(text) >= 2 * above, F.size(F.filter(F.split(F.col(text), SPACE_RE + "+"), lambda w: w != ""))).otherwise(0)


def periodic_runs(docs: DataFrame, text: str = "text", least: int = 12, exponent: int = 2, work: int = WORK) -> DataFrame:
    """Add ``runs``, an array of (start, length, period) by start and period, and ``collapsed``, the text without what runs repeat.

    A run is a stretch of words of smallest period q, at least ``least`` and ``exponent`` * q words long, that no neighbouring
    word extends. The collapsed text keeps the first q words of each run (unless another run repeats them), joined by
    one space."""
    if exponent < 2:
        raise ValueError("a run holds its period at least twice")
    kept = [F.col(f"`{c}`") for c in others(docs, "runs", "collapsed")]
    body, n, key, part, parts, found = (unused(x, docs) for x in ("body", "n", "key", "part", "parts", "found"))
    rows = docs.select(*kept, F.col(f"`{text}`").alias(body))
    # of n words and n / exponent lags
    per = (1 / exponent - 1 / (2 * exponent**2)) / work
    above = int(per**-0.5)
    number = _n_words(body, above)
    short = rows.filter(number <= above).withColumn(found, _whole(least, exponent)(body))
    short = short.select(*kept, F.col(f"{found}.runs").alias("runs"), F.coalesce(f"{found}.collapsed", F.lit("")).alias("collapsed"))
    long = rows.filter(number > above).withColumn(key, F.sha2(body, 256))
    items = long.select(body, key, F.ceil(per * number.cast("double") * number).cast("int").alias(parts))
    items = items.select("*", F.explode(F.sequence(F.lit(0), F.col(parts) - 1)).alias(part)).repartition(key, part)
    each = items.select(key, F.explode(_range(least, exponent)(body, part, parts)).alias(found)).select(key, f"{found}.*")
    each = each.groupBy(key, "start", "length").agg(F.min("period").alias("period"))
    each = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias(found))
    merged = long.join(each, key, "left").withColumn(found, F.coalesce(found, F.array().cast(RUNS)))
    merged = merged.select(*kept, F.col(found).alias("runs"), _collapsed(body, found).alias("collapsed"))
    return short.union(merged)


def with_tails(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` where texts of one id in ten get a periodic tail, as the query's contract has it.

    With h the crc32 of the id in decimal and g = h / 10: where 10 divides h, each word i >= a of n becomes word
    a + (i - a) % p, with a = g % n and p = 1 + (n - a) / (3 + g % 8); others and rows without an id stay."""
    h = F.crc32(F.col(id).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col(text), SPACE_RE + "+"), lambda w: w != "")

    def tail(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        repeated = F.transform(F.sequence(a, n - 1), lambda i: F.get(w, (a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), repeated), " ")).otherwise("")

    # a one-element array binds the words to a name, so that they are split once
    planted = F.get(F.transform(F.array(words), tail), 0)
    return docs.withColumn(text, F.when((h % 10 == 0) & F.col(text).isNotNull(), planted).otherwise(F.col(text)))
