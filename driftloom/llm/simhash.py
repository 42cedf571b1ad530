"""SimHash near-duplicates by anchor-point covering.

A text's fingerprint is the bitwise majority of the hashes of its word shingles. Two fingerprints at distance two or
less have a midpoint within one bit of both. Anchors are the words of a covering code of the 64-bit space: nine
blocks of seven bits, each covered with radius one by the perfect (7, 4) Hamming code, and the last bit as it is.
Each fingerprint goes to the anchors of all midpoints that it may have: those that lie within the covering radius
plus its half of the threshold, some 26 of 2^37. At each anchor fingerprints are compared with each other, and those
connected there get an edge to the first of them, so that a group needs no list of its pairs. Anchors of more than
``MOST`` fingerprints are not held in a task: these meet at their midpoints instead (those with the same midpoint, 65 at
most, are within two bits of each other, and all that are within two bits share one), dealt over all tasks.

Cases: a null or empty text, or one without words, has fingerprint 0 and is linked like any other; a text of fewer
words than a shingle is one shingle; repeated rows have equal fingerprints and one component; a row without an id
gets its component from the rows that have one (null if none has); an empty table gives an empty table. Only the id
and the text are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, checkpointed, fields, slices
from .graph import components

SEED = 42
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 15
#: Fingerprints of an anchor that are compared in one task.
MOST = 1024
_LOWER = LOWER.tobytes()


def shingles(text: str | None, words: int = 3) -> np.ndarray:
    """The hashes of a text's shingles in order, as often as they occur."""
    w = (text or "").encode().translate(_LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(x) for x in zip(*(w[k:] for k in range(words)), strict=False)] if len(w) >= words else [b" ".join(w)]
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(grams))


def majority(hashes: np.ndarray) -> int:
    """The unsigned 64-bit fingerprint of these hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    return majority(shingles(text, words))


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """One row (id, fp) for each row; fp holds the fingerprint's bits in a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            fps = np.fromiter((fingerprint(t, words) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=[id, "fp"])

    return docs.select(id, text).mapInArrow(run, f"{fields(docs, id)}, fp long")


def _nearest() -> np.ndarray:
    """For each 7-bit value the word of the Hamming code within one bit: flip the bit that the syndrome names."""
    out = np.zeros(128, np.uint64)
    for v in range(128):
        syndrome = 0
        for bit in range(7):
            if v >> bit & 1:
                syndrome ^= bit + 1
        out[v] = v ^ (1 << (syndrome - 1)) if syndrome else v
    return out


def anchor_of(x: np.ndarray) -> np.ndarray:
    """The anchor nearest to each 64-bit value."""
    nearest, out = _nearest(), x & np.uint64(1 << 63)
    for b in range(9):
        shift = np.uint64(7 * b)
        out |= nearest[(x >> shift) & np.uint64(127)] << shift
    return out


def midpoints(x: np.ndarray) -> np.ndarray:
    """Each value and its 64 neighbours."""
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    return x[:, None] ^ flips[None, :]


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 1 << 14):
            fp = _longs(batch.slice(i, 1 << 14), "fp")
            anchors = np.sort(anchor_of(midpoints(fp)), axis=1)
            new = np.ones(anchors.shape, bool)
            new[:, 1:] = anchors[:, 1:] != anchors[:, :-1]
            rows = np.nonzero(new)[0]
            yield pa.record_batch([pa.array(anchors[new].view(np.int64)), pa.array(fp[rows].view(np.int64))], names=["anchor", "fp"])


def _classes(fps: np.ndarray) -> np.ndarray:
    """For each fingerprint the first one that it is connected to by links of two bits or less."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    label = np.arange(len(fps))
    while True:
        least = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (least == label).all():
            return label
        label = least


def _at_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, anchor): edges of the anchors, and (fp, null, anchor) of those with too many; they come sorted by anchor."""
    anchor = fp = np.zeros(0, np.uint64)
    full: np.uint64 | None = None  # the anchor at the end of the last batch, if it has too many

    def out(a: np.ndarray, b: np.ndarray | None, anchor: np.ndarray | None) -> pa.RecordBatch:
        columns = [pa.nulls(len(a), pa.int64()) if x is None else pa.array(x.view(np.int64)) for x in (a, b, anchor)]
        return pa.record_batch(columns, names=["a", "b", "anchor"])

    def settled(anchor: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1], [True]]))
        size = np.diff(edge)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        pair = edge[:-1][size == 2]
        pair = pair[np.bitwise_count(fp[pair] ^ fp[pair + 1]) <= 2]
        found.append((fp[pair], fp[pair + 1]))
        for g in np.flatnonzero((size > 2) & (size <= MOST)).tolist():
            here = fp[edge[g] : edge[g + 1]]
            label = _classes(here)
            moved = np.flatnonzero(label != np.arange(len(label)))
            found.append((here[label[moved]], here[moved]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(a):
            yield out(a, b, None)
        many = np.repeat(size > MOST, size)
        if many.any():
            yield out(fp[many], None, anchor[many])

    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, fp = np.concatenate([anchor, _longs(batch, "anchor")]), np.concatenate([fp, _longs(batch, "fp")])
        if full is not None:
            on = anchor == full
            if on.any():
                yield out(fp[on], None, anchor[on])
            anchor, fp = anchor[~on], fp[~on]
            if not len(anchor):
                continue
            full = None
        cut = int(np.searchsorted(anchor.view(np.int64), anchor.view(np.int64)[-1]))  # the last anchor may go on
        if cut:
            yield from settled(anchor[:cut], fp[:cut])
        anchor, fp = anchor[cut:], fp[cut:]
        if len(anchor) > MOST:
            full = anchor[0]
            yield out(fp, None, anchor)
            anchor, fp = anchor[:0], fp[:0]
    if len(anchor):
        yield from settled(anchor, fp)


def _at_midpoint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 1 << 14):
            part = batch.slice(i, 1 << 14)
            fp, anchor = _longs(part, "a"), _longs(part, "anchor")
            middle = midpoints(fp)
            rows, columns = np.nonzero(anchor_of(middle) == anchor[:, None])
            yield pa.record_batch([pa.array(middle[rows, columns].view(np.int64)), pa.array(fp[rows].view(np.int64))], names=["middle", "fp"])


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect just what is within two bits."""
    reached = distinct.select("fp").mapInArrow(_to_anchors, "anchor long, fp long")
    met = checkpointed(reached.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_at_anchor, "a long, b long, anchor long"))
    middle = met.filter("b is null").mapInArrow(_at_midpoint, "middle long, fp long")
    middle = middle.groupBy("middle").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    middle = middle.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return met.filter("b is not null").select("a", "b").union(middle).distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(id, fingerprint, component_id): the component's smallest id, links being two differing bits or fewer."""
    fps = checkpointed(fingerprints(docs, id, text, words))
    first = checkpointed(fps.groupBy("fp").agg(F.min(id).alias("first")))
    labels = components(links(first)).select(F.col("node").alias("fp"), "component")
    labelled = first.join(labels, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = labelled.join(least, "component").select("fp", "component_id")
    return fps.join(classes, "fp").select(id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """The rows of ``docs`` that are first of their component; rows without an id stay."""
    gone = near_duplicates(docs, id, text, words).filter(F.col("component_id") < F.col(id)).select(id)
    return docs.join(gone, id, "left_anti").select(docs.columns)
