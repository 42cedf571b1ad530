"""Line deduplication by a segment-partition edit join.

Lines are the \\n-split parts of a text without blanks at either end; blank lines take no part. Two lines are linked if
they are equal or their edit distance in bytes is at most the threshold of the shorter one (``threshold``: 0 below 20
bytes, 1 below 40, else 2). Of each class of linked lines (links count transitively) the first stays, by document id
and place in the document; the others are removed.

Join: a line of length l is cut into threshold + 1 segments, of which a linked line has at least one unchanged. Each
line indexes its segments under its length, where equally long lines meet, and probes the other substrings of its own
that an equal or shorter line's segments may equal; those that some alignment within the threshold cannot reach are not probed. Index and probe entries
meet by hash in sorted partitions. Entries of a key are compared by their byte histograms (folded into 16 counters;
each edit changes at most two by one). Candidate pairs are verified by a banded bit-parallel edit distance.

Probes meet index entries only, so keys without an index entry, however many lines probe them, bring nothing together and
end in their task. Keys of more than ``HOT`` entries are not compared in theirs. Their entries are keyed anew by parts of
the histograms (linked lines agree in at least two of six parts, so each line has fifteen such keys), unless all are alike.
Of those, of keys that are hot still, and of those with more than ``FEW`` near pairs for each entry, lines
are compared with leaders turn by turn, then those that are still apart with each other, dealt over tasks
(``graph.connected``). No index entry that another line meets and no pair of different classes is dropped.

Lines are told apart by 128-bit BLAKE2b digests of their bytes, keys by half as long hashes; the latter only bring lines
together that are then compared in full.

Cases: null and empty texts have no line and stay as they are; rows of one id count as one document, so repeated rows
lose and keep the same lines; rows without an id come last in order and keep all lines; a document that loses every
line has an empty text; an empty table gives an empty table. Other columns are kept; n_lines and n_removed are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, Block, SpanHasher, blocks, checkpointed, fields, likely, mixed, others, release, slices, unused
from .graph import connected

#: Lengths from which one and two edits are allowed.
ONE, TWO = 20, 40
#: Entries of a key up to which they are compared in one task, and near pairs for each of them up to which these leave it.
HOT, FEW = 4096, 2
#: Entries of a key held to see whether all are alike, and how far from the first their histograms then are at most.
HELD, ALIKE = 1 << 16, 8
#: Pairs verified at a time, bytes of their lines, and bytes between two looks for pairs that are too far apart already.
CHUNK, CHUNK_BYTES, LOOK = 4096, 4 << 20, 64
#: Pairs of histograms compared at a time.
NEAR_PAIRS = 1 << 16
#: Histograms of linked lines differ by at most 4 in all, so of six parts of the counters two are equal.
PARTS = [sum(15 << 4 * c for c in range(16) if c % 6 in kept) for kept in combinations(range(6), 2)]


def threshold(length: np.ndarray) -> np.ndarray:
    return (length >= ONE).astype(np.int64) + (length >= TWO)


def lines(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, number of the text and place in the text of each line that is not blank."""
    breaks = np.flatnonzero(block.data == 10)
    starts = np.sort(np.concatenate([block.offsets[:-1], breaks + 1]), kind="stable")
    # a break at the end of a text begins a line there, before the next text's first line
    text = np.repeat(np.arange(block.n), np.bincount(np.searchsorted(block.offsets, breaks, "right") - 1, minlength=block.n) + 1)
    begin = np.cumsum(np.concatenate([np.zeros(1, np.int64), np.bincount(text, minlength=block.n)]))[:-1]
    place = np.arange(len(text)) - begin[text]
    last = np.concatenate([starts[1:] - 1, [len(block.data)]])
    last = np.where(np.concatenate([text[1:] != text[:-1], [True]]), block.offsets[1:][text], last) if len(text) else last[:0]
    solid = np.flatnonzero(~_SPACE[block.data])
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, last)
    some = high > low
    return solid[low[some]], solid[high[some] - 1] + 1, text[some], place[some]


def segment(length: np.ndarray, k: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment ``which`` of k + 1 nearly equal ones; the last are longer by one where needed."""
    size, longer = length // (k + 1), length % (k + 1)
    plain = k + 1 - longer
    return which * size + np.maximum(0, which - plain), size + (which >= plain)


def entries(hasher: SpanHasher, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(key, line number, whether it is a probe) of all entries of the lines."""
    length = end - start

    def key(at: np.ndarray, size: np.ndarray, whole: np.ndarray, which: int) -> np.ndarray:
        return mixed(hasher(at, at + size) + (whole * 4 + which).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    for which in range(3):
        k = threshold(length)
        rows = np.flatnonzero((k > 0) & (which <= k))
        first, size = segment(length[rows], k[rows], which)
        yield key(start[rows] + first, size, length[rows], which), rows, False
    for less in range(3):  # how much shorter the other line is
        other = length - less
        k = threshold(other)
        for which in range(3):
            rows = np.flatnonzero((k > 0) & (which <= k) & (less <= k))
            if not len(rows):
                continue
            kr = k[rows]
            first, size = segment(other[rows], kr, which)
            low = np.maximum(np.maximum(first - which, first + less - (kr - which)), 0)
            high = np.minimum(np.minimum(first + which, first + less + (kr - which)), length[rows] - size)
            for shift in range(int((high - low).max(initial=-1)) + 1):
                fits = low + shift <= high
                if not less:  # there the index entry itself is the probe
                    fits &= low + shift != first
                r = rows[fits]
                yield key(start[r] + low[fits] + shift, size[fits], other[r], which), r, True


#: For each of four groups of counters, what a byte adds to the group's four 16-bit fields.
_FIELDS = [np.where((np.arange(256) & 12) == 4 * g, np.uint64(1) << (16 * (np.arange(256) & 3)).astype(np.uint64), np.uint64(0)) for g in range(4)]


def histograms(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Counts of bytes modulo 16 in each line, each modulo 16, as one 64-bit value; the lines are in order."""
    out = np.zeros(len(start), np.uint64)
    if not len(start):
        return out
    bounds = np.stack([start, end], axis=1).ravel()
    for g in range(4):
        fields_ = np.append(_FIELDS[g][data], np.uint64(0))
        total = np.add.reduceat(fields_, bounds)[::2]
        for c in range(4):
            out |= (total >> np.uint64(16 * c) & np.uint64(15)) << np.uint64(16 * g + 4 * c)
    for i in np.flatnonzero(end - start > 65535):  # fields may have run over
        counts = np.bincount(data[start[i] : end[i]] & 15, minlength=16) & 15
        out[i] = sum(int(n) << 4 * c for c, n in enumerate(counts))
    return out


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How much histograms a and b differ in all, counters compared modulo 16."""
    total = np.zeros(np.broadcast_shapes(a.shape, b.shape), np.int64)
    for c in range(16):
        d = ((a >> np.uint64(4 * c)) - (b >> np.uint64(4 * c)) & np.uint64(15)).astype(np.int64)
        total += np.minimum(d, 16 - d)
    return total


def _near(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the histograms a[i] and b[j] that differ by at most ``most``."""
    x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, NEAR_PAIRS // max(1, len(b)))
    for i in range(0, len(a), step):
        other = a[i : i + step, None] ^ b[None, :]
        other |= other >> np.uint64(1)
        other |= other >> np.uint64(2)
        other &= np.uint64(0x1111111111111111)  # a bit for each counter that differs; such histograms differ by one at least
        p, q = np.nonzero(np.bitwise_count(other) <= most)
        same = _differ(a[i + p], b[q]) <= most
        x.append(i + p[same])
        y.append(q[same])
    return np.concatenate(x), np.concatenate(y)


def _distinct(block: Block) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Start, end and bytes of the different lines of a block that may have near ones."""
    start, end, _, _ = lines(block)
    long = end - start >= ONE
    raw = block.data.tobytes()
    at = {raw[s:e]: s for s, e in zip(start[long].tolist(), end[long].tolist(), strict=True)}
    first = np.fromiter(at.values(), np.int64, len(at))
    order = np.argsort(first)
    found = list(at)
    found = [found[i] for i in order.tolist()]
    return first[order], first[order] + np.fromiter(map(len, found), np.int64, len(found)), found


def digest(line: bytes) -> bytes:
    return blake2b(line, digest_size=16).digest()


def _short(digests: list[bytes]) -> np.ndarray:
    """Half of each digest, but for the lowest bit."""
    return np.frombuffer(b"".join(digests), np.uint64)[::2] & ~np.uint64(1)


def _to_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, line, bag): the sign of ``line`` tells index entries, which thus come first, from probes; the other bits are
    those of the short digest but for its lowest."""
    for _, block in blocks(batches, "text"):
        start, end, found = _distinct(block)
        if not len(start):
            continue
        line, bag = _short(list(map(digest, found))), histograms(block.data, start, end)
        del found
        for key, rows, probe in entries(SpanHasher(block.data), start, end):
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array((line[rows] >> ONE_BIT | np.uint64(not probe) << INDEX).view(np.int64)), pa.array(bag[rows].view(np.int64))], names=["key", "line", "bag"])


MET = "key long, a long, b long, bag long"
#: Place of the sign of an index entry.
INDEX, ONE_BIT = np.uint64(63), np.uint64(1)


def _to_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of keys of up to HOT entries (key null, a, b): lines with near histograms, a < b. Of others, and of those with too
    many pairs or all alike (b 1, else null), the entries (key, a, b, bag) with a the line as it came. Keys without an
    index entry or of one line give nothing. The entries come sorted by key and line."""
    key = line = bag = np.zeros(0, np.uint64)
    hot: np.uint64 | None = None  # the key at the end of the last batch, if it is known to be hot
    index = False  # whether that key has an index entry

    def out(keys, a, b, bags) -> pa.RecordBatch:
        n = len(a)
        columns = [pa.nulls(n, pa.int64()) if x is None else pa.array(x.view(np.int64)) for x in (keys, a, b, bags)]
        return pa.record_batch(columns, names=["key", "a", "b", "bag"])

    def settled(key: np.ndarray, line: np.ndarray, bag: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size, plain = np.diff(edge), line << ONE_BIT
        # index entries are first
        several = (line[edge[:-1]] >> INDEX).astype(bool)
        several &= np.minimum.reduceat(plain, edge[:-1]) != np.maximum.reduceat(plain, edge[:-1])
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        dense = np.zeros(len(size), bool)
        for g in np.flatnonzero(several).tolist():
            i, j = edge[g], edge[g + 1]
            if j - i > HOT:
                dense[g] = (_differ(bag[i:j], bag[i : i + 1]) <= ALIKE).all()
                continue
            n = int(np.count_nonzero(line[i:j] >> INDEX))
            x, y = _near(bag[i:j], bag[i : i + n], 4)
            other = plain[i + x] != plain[i + y]
            x, y = x[other], y[other]
            if len(x) > 2 * FEW * (j - i):
                dense[g] = True
            elif len(x):
                pairs.append((plain[i + x], plain[i + y]))
        if pairs:
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield out(None, a, b, None)
        for rows, mark in ((several & ~dense & (size > HOT), None), (dense, np.ones(int(size[dense].sum()), np.int64))):
            many = np.repeat(rows, size)
            if many.any():
                yield out(key[many], line[many], mark, bag[many])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, line, bag = (np.concatenate([x, batch.column(c).to_numpy().view(np.uint64)]) for x, c in ((key, "key"), (line, "line"), (bag, "bag")))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
        key, line, bag = key[new], line[new], bag[new]
        if hot is not None:
            n = int(np.argmax(key != hot)) if (key != hot).any() else len(key)
            if n and index:
                yield out(key[:n], line[:n], None, bag[:n])
            if n == len(key):
                key, line, bag = key[n:], line[n:], bag[n:]
                continue
            key, line, bag, hot = key[n:], line[n:], bag[n:], None
        # the last key may go on in the next batch
        cut = int(np.searchsorted(key.view(np.int64), key.view(np.int64)[-1]))
        if cut:
            yield from settled(key[:cut], line[:cut], bag[:cut])
        key, line, bag = key[cut:], line[cut:], bag[cut:]
        index = bool(line[0] >> INDEX)
        if not index or len(key) > HELD:
            hot = key[0]
            if index:
                yield out(key, line, None, bag)
            key, line, bag = key[:0], line[:0], bag[:0]
    if len(key):
        yield from settled(key, line, bag)


def _apart(x: bytes, y: bytes) -> tuple[bytes, bytes]:
    """Two lines without what they have in common at the start and at the end, which costs no edits."""
    n = min(len(x), len(y))
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    differ = a[:n] != b[:n]
    low = int(differ.argmax()) if differ.any() else n
    n -= low
    differ = (a[len(x) - n :] != b[len(y) - n :])[::-1]
    high = int(differ.argmax()) if differ.any() else n
    return x[low : len(x) - high], y[low : len(y) - high]


def distances(first: list[bytes], second: list[bytes], most: int = 2) -> np.ndarray:
    """Edit distances of pairs by a bit-parallel recurrence over a band around the diagonal, side by side in numpy.

    Exact up to ``most``; what exceeds it is reported as more. Bit 63 stands for the row ``most`` below the diagonal.
    A path of at most ``most`` edits leaves no value above three times ``most`` in the band, so pairs with one are given up."""
    both = [_apart(x, y) for x, y in zip(first, second, strict=True)]
    out = np.full(len(both), most + 1, np.int64)
    n1, n2 = np.array([len(x) for x, _ in both], np.int64), np.array([len(y) for _, y in both], np.int64)
    rows = np.flatnonzero(np.abs(n1 - n2) <= most)
    n1, n2 = n1[rows], n2[rows]
    size = len(rows)
    score = np.minimum(n1, most)
    width = int(max(n1.max(initial=0), n2.max(initial=0)))
    one = np.full((size, width + 3 * most + 2), -1, np.int16)
    two = np.full((size, width + 1), -2, np.int16)
    for i, k in enumerate(rows.tolist()):
        x, y = both[k]
        one[i, most : most + len(x)] = np.frombuffer(x, np.uint8)
        two[i, : len(y)] = np.frombuffer(y, np.uint8)
    top, ones = np.uint64(63), np.uint64(1)
    vp = np.full(size, (~np.uint64(0)) << np.uint64(63 - most))
    vn = np.zeros(size, np.uint64)
    j = 0
    while len(rows):
        if j % LOOK == 0 or j == width:
            done = j >= n2
            out[rows[done]] = np.minimum(score[done], most + 1)
            left = ~done & (score <= 3 * most)
            if not left.all():
                rows, n1, n2, score, vp, vn, one, two = (v[left] for v in (rows, n1, n2, score, vp, vn, one, two))
                continue
        eq = np.zeros(len(rows), np.uint64)
        for t in range(2 * most + 1):
            eq |= (one[:, j + t] == two[:, j]).astype(np.uint64) << np.uint64(63 - 2 * most + t)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        live = j < n2
        diagonal = j < n1 - most
        score += live & diagonal & ((d0 >> top) == 0)
        # past the last row within the band the score moves along the row instead
        row = np.clip(62 - (j - (n1 - most)), 0, 63).astype(np.uint64)
        along = ((hp >> row) & ones).astype(np.int64) - ((hn >> row) & ones).astype(np.int64)
        score += np.where(live & ~diagonal, along, 0)
        vp, vn = hn | ~((d0 >> ones) | hp), (d0 >> ones) & hp
        j += 1
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [pa.compute.binary_length(batch.column(c)).to_numpy() for c in ("x", "y")]
        shorter, longer = np.minimum(*sizes).astype(np.int64), np.maximum(*sizes).astype(np.int64)
        order = np.argsort(longer, kind="stable")
        i = 0
        while i < len(order):  # pairs of like length, as many as their bytes allow
            n = 1
            while n < CHUNK and i + n < len(order) and (n + 1) * longer[order[i + n]] <= CHUNK_BYTES:
                n += 1
            rows = order[i : i + n]
            part = batch.take(pa.array(rows))
            d = distances(part.column("x").to_pylist(), part.column("y").to_pylist())
            yield part.filter(pa.array(d <= threshold(shorter[rows]))).select(["a", "b"])
            i += n


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, block in blocks(batches, "text"):
        start, end, text, place = lines(block)
        if len(start):
            raw, seen = block.data.tobytes(), {}
            each = []
            for s, e in zip(start.tolist(), end.tolist(), strict=True):
                line = raw[s:e]
                d = seen.get(line)
                if d is None:
                    d = seen[line] = digest(line)
                each.append(d)
            yield pa.record_batch([pa.array(each, pa.binary()), pa.array(_short(each).view(np.int64)), batch.column("id").take(pa.array(text)), pa.array(place)], names=["line", "short", "id", "place"])


def _at_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line, bytes) of the lines at the places in the column ``places``."""
    for batch in slices(batches, "text"):
        for t, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
            parts = (t or "").split("\n")
            found = [parts[p].strip(" \t\n\x0b\x0c\r").encode() for p in places if p < len(parts)]  # other rows may have the same id
            each = list(map(digest, found))
            yield pa.record_batch([pa.array(each, pa.binary()), pa.array(found, pa.binary())], names=["line", "bytes"])


def _alike(a: Column, b: Column) -> Column:
    """Whether two histograms differ by 4 at most, counters compared modulo 16."""
    total = F.lit(0)
    for c in range(16):
        d = (F.shiftright(a, 4 * c).bitwiseAND(F.lit(15)) - F.shiftright(b, 4 * c).bitwiseAND(F.lit(15))).bitwiseAND(F.lit(15))
        total += F.least(d, 16 - d)
    return total <= 4


class Join:
    """The edit join of the lines of ``rows`` (id, text); ``firsts`` has (line, short, first, n) of each line."""

    def __init__(self, rows: DataFrame, firsts: DataFrame):
        self.rows, self.firsts = rows, firsts

    def fetched(self, names: DataFrame) -> DataFrame:
        """(line, bytes) of the lines ``names`` (line, first), each from its first place. Of the texts only those move that
        hold such a place."""
        at = names.groupBy(F.col("first.id").alias("at")).agg(F.collect_list("first.place").alias("places"))
        texts = likely(self.rows, "id", at, "at").join(at, F.col("id") == F.col("at")).select("text", "places")
        return texts.mapInArrow(_at_places, "line binary, bytes binary").groupBy("line").agg(F.min("bytes").alias("bytes"))

    def classes(self) -> DataFrame:
        """(node, component) of the lines that are linked to others."""
        spark = self.rows.sparkSession
        keyed = self.rows.select("text").mapInArrow(_to_entries, "key long, line long, bag long")
        met = checkpointed(keyed.repartition("key").sortWithinPartitions("key", "line").mapInArrow(_to_pairs, MET))
        release(spark)  # the entries are more than the texts, and the heap does not fill before the disk does
        parts = F.array(*[F.xxhash64("key", F.lit(i), F.col("bag").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for i, m in enumerate(PARTS)])
        again = met.filter("key is not null and b is null").select(F.explode(parts).alias("key"), F.col("a").alias("line"), "bag")
        met2 = checkpointed(again.repartition("key").sortWithinPartitions("key", "line").mapInArrow(_to_pairs, MET))
        pairs = met.union(met2).filter("key is null").select("a", "b").distinct()
        hot = met.filter("b = 1").union(met2).filter("key is not null").select("key", F.shiftleft("a", 1).alias("a"), "bag").distinct()
        # from the short digests to the lines that have them
        wanted = pairs.select(F.col("a").alias("short")).union(pairs.select("b")).union(hot.select("a")).distinct()
        names = checkpointed(self.firsts.join(wanted, "short").select("short", "line", "first"))
        x, y = names.select(F.col("short").alias("a"), F.col("line").alias("x")), names.select(F.col("short").alias("b"), F.col("line").alias("y"))
        pairs = checkpointed(pairs.join(x, "a").join(y, "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
        hot = checkpointed(hot.join(x, "a").select("key", F.col("x").alias("node"), F.col("bag").alias("x")))
        texts = checkpointed(self.fetched(names))
        release(spark)

        def verified(pairs: DataFrame) -> DataFrame:
            """Those of the pairs (a, b) of lines that are within the threshold."""
            both = pairs.join(texts.select(F.col("line").alias("a"), F.col("bytes").alias("x")), "a").join(texts.select(F.col("line").alias("b"), F.col("bytes").alias("y")), "b")
            return both.select("a", "b", "x", "y").mapInArrow(_verified, "a binary, b binary")

        return connected(verified(pairs), hot, _alike, verified)


def removals(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, places): the lines of each document that are not the first of their class."""
    rows = docs.filter(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"))
    found = checkpointed(rows.mapInArrow(_occurrences, f"line binary, short long, {fields(rows, 'id')}, place long"))
    firsts = checkpointed(found.groupBy("line").agg(F.min("short").alias("short"), F.min(F.struct("id", "place")).alias("first"), F.count("*").alias("n")))
    linked = Join(rows, firsts).classes().select(F.col("node").alias("line"), "component")
    firsts = firsts.join(linked, "line", "left").filter("n > 1 or component is not null")
    firsts = firsts.select("line", "first", F.coalesce("component", "line").alias("component"))
    kept = firsts.groupBy("component").agg(F.min("first").alias("keep"))
    gone = found.join(firsts.join(kept, "component").select("line", "keep"), "line").filter(F.struct("id", "place") != F.col("keep"))
    return gone.groupBy("id").agg(F.collect_set("place").alias("places"))


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the lines that are not the first of their class, with n_lines and n_removed."""
    names = others(docs, "n_lines", "n_removed")
    whose, places_ = unused("gone_id", docs), unused("gone_places", docs)
    gone = removals(docs, id, text).select(F.col("id").alias(whose), F.col("places").alias(places_))
    joined = docs.select(*[F.col(f"`{c}`") for c in names]).join(gone, F.col(f"`{id}`") == F.col(whose), "left").drop(whose)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text)
        for batch in slices(batches, text):
            texts, total, removed = [], [], []
            for t, places in zip(batch.column(text).to_pylist(), batch.column(places_).to_pylist(), strict=True):
                parts = (t or "").split("\n")
                total.append(sum(1 for p in parts if p.strip(" \t\n\x0b\x0c\r")))
                removed.append(len(places or ()))
                if places:
                    out = set(places)
                    parts = [p for i, p in enumerate(parts) if i not in out]
                    if not any(p.strip(" \t\n\x0b\x0c\r") for p in parts):
                        parts = []
                    t = "\n".join(parts)
                texts.append(t)
            columns = list(batch.select(names).columns)
            columns[at] = pa.array(texts, batch.schema.field(text).type)
            yield pa.record_batch([*columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=[*names, "n_lines", "n_removed"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return joined.mapInArrow(run, f"{schema}, n_lines long, n_removed long")
