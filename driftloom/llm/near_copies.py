"""Near copies: texts that share four fifths of their shingles, or whose SimHash fingerprints differ in two bits or less.

Texts with the same shingles are one node. Two sets of shingles of a Jaccard similarity of 0.8 or more share one of the
first n - ceil(0.8 n) + 1 shingles of each, in whatever order all sets are sorted. So each node is entered under these
shingles only. Nodes of a common entry are candidates if their sizes allow it and so do their sketches: 256 bits, each
the parity of the shingles that fall to it, of which two sets differ in no more than they differ in shingles, a ninth of
both sizes at most. Of the pairs found, only those are verified by their whole sets whose wide sketches allow it too:
these have a bit for each shingle, so that unlike texts of any length are told apart without their sets. No such pair is
lost.
The order is by the count in a sample of the texts, then by hash: common phrases come last and are seldom entered.
The sample decides what the join costs, not what it finds.

Only components are asked for, so nodes that are connected already need no comparison (``graph.connected``): a large
group of near copies makes pairs in proportion to its size.

Cases: rows without an id stay and take no part; a null or empty text, or one without words, has no shingle and is
linked by its fingerprint; a text of fewer words than a shingle is one shingle; repeated rows are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, checkpointed, fields, remove_folder, slices
from .graph import connected
from .simhash import links, majority, shingles

#: The order of shingles is learned from one text in SPARSE, of large corpora from some SAMPLE texts; the occurrences and
#: number of shingles that are moved back.
SPARSE, SAMPLE, LEAST, MOST_COMMON = 8, 50_000, 4, 200_000


def _node(hashes: np.ndarray) -> int:
    """One signed value for the hashes, as often as they occur."""
    return int(np.uint64(xxhash.xxh64_intdigest(np.sort(hashes).tobytes())).view(np.int64))


def sketch(own: np.ndarray) -> np.ndarray:
    """Four numbers whose bits are the parities of the different hashes by their leading byte."""
    odd = np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


ABOUT = ("n", "s0", "s1", "s2", "s3")


def wide_sketch(own: np.ndarray) -> bytes:
    """The parities of the different hashes by their low bits: a power of two of them, as many as hashes or more."""
    bits = max(256, 1 << (len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two wide sketches differ, the longer one folded to the size of the shorter one."""
    short, long = sorted((np.frombuffer(s, np.uint8) for s in (x, y)), key=len)
    while len(long) > len(short):
        half = len(long) // 2
        long = long[:half] ^ long[half:]
    return int(np.bitwise_count(short ^ long).sum())


def _described(rows: DataFrame, id: str, text: str, words: int) -> DataFrame:
    """(id, fp, node, x, wide) of each row; x has the number of its different shingles and their sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            each = [shingles(t, words) for t in batch.column(text).to_pylist()]
            fps = np.fromiter(map(majority, each), np.uint64, len(each)).view(np.int64)
            own = list(map(np.unique, each))
            about = np.array([[len(u), *sketch(u)] for u in own], np.int64)
            x = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(about[:, i])) for i in range(len(ABOUT))], list(ABOUT))
            wide = pa.array(map(wide_sketch, own), pa.binary())
            yield pa.record_batch([batch.column(id), pa.array(fps), pa.array(map(_node, each), pa.int64()), x, wide], names=[id, "fp", "node", "x", "wide"])

    return rows.mapInArrow(run, f"{fields(rows, id)}, fp long, node long, x struct<{', '.join(f'{c}:bigint' for c in ABOUT)}>, wide binary")


def _common(rows: DataFrame, id: str, text: str, words: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample of the texts, sorted, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            each = [np.unique(shingles(t, words)) for t in batch.column(text).to_pylist()]
            yield pa.record_batch([pa.array(np.concatenate(each).view(np.int64))], names=["key"])

    drawn = rows.filter(F.pmod(F.xxhash64(id), F.lit(max(SPARSE, n // SAMPLE + 1))) == 0)
    counts = drawn.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST)
    table = counts.orderBy(F.desc("n"), "key").limit(MOST_COMMON).toPandas()
    key = table["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], table["n"].to_numpy(np.int64)[order]


def _entries(rows: DataFrame, text: str, words: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, node): the shingles under which each node is entered."""
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = shared.value
        for batch in slices(batches, text):
            keys, nodes, seen = [np.zeros(0, np.uint64)], [], set()
            for t in batch.column(text).to_pylist():
                hashes = shingles(t, words)
                node = _node(hashes)
                if not len(hashes) or node in seen:
                    continue
                seen.add(node)
                own = np.unique(hashes)
                at = np.searchsorted(known, own)
                hit = at < len(known)
                hit[hit] = known[at[hit]] == own[hit]
                rank = np.zeros(len(own), np.int64)
                rank[hit] = count[at[hit]]
                n = len(own)
                keys.append(own[np.argsort(rank, kind="stable")[: n + (-4 * n // 5) + 1]])
                nodes.append(node)
            each = [len(k) for k in keys[1:]]
            yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), each))], names=["key", "node"])

    return rows.select(text).mapInArrow(run, "key long, node long")


def _likely(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose wide sketches allow four fifths of common shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differ = np.fromiter(map(differing, batch.column("u").to_pylist(), batch.column("v").to_pylist()), np.int64, batch.num_rows)
            yield batch.select(["a", "b"]).filter(pa.array(9 * differ <= batch.column("n").to_numpy()))

    one = first.select(F.col("node").alias("a"), F.col("x.n").alias("m"), F.col("wide").alias("u"))
    two = first.select(F.col("node").alias("b"), F.col("x.n").alias("n"), F.col("wide").alias("v"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", (F.col("m") + F.col("n")).alias("n"), "u", "v")
    return both.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, first: DataFrame, rows: DataFrame, id: str, text: str, words: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that share four fifths of their shingles."""
    pairs = checkpointed(_likely(pairs, first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            nodes, sets = [], []
            for t, node in zip(batch.column(text).to_pylist(), batch.column("node").to_pylist(), strict=True):
                hashes = shingles(t, words)
                if _node(hashes) == node:  # other rows may have the same id
                    nodes.append(node)
                    sets.append(np.unique(hashes).view(np.int64))
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(first, "node").select(F.col("first").alias(id), "node")
    sets = checkpointed(rows.join(wanted, id).select("node", text).mapInArrow(run, "node long, set array<long>"))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return both.filter(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def _alike(a: Column, b: Column) -> Column:
    """Whether sets of these sizes and sketches can be similar."""
    differ = sum((F.bit_count(a[f"s{i}"].bitwiseXOR(b[f"s{i}"])) for i in range(4)), F.lit(0))
    return (5 * F.least(a["n"], b["n"]) >= 4 * F.greatest(a["n"], b["n"])) & (9 * differ <= a["n"] + b["n"])


def near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5) -> DataFrame:
    """(id, component_id): the smallest id of the component, for the rows that have an id."""
    rows = docs.select(id, text).filter(F.col(id).isNotNull())
    tables = Tables(docs.sparkSession, "near-copies")
    described = checkpointed(_described(rows, id, text, words))
    first = checkpointed(described.groupBy("node").agg(F.min(id).alias("first"), F.min("fp").alias("fp"), F.min("x").alias("x"), F.min("wide").alias("wide")))
    entries = tables.write(_entries(rows, text, words, _common(rows, id, text, words, first.count())))
    ends = entries.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("key")
    # sizes and sketches only join the entries that meet others; the files' size says little of the rows', so none is broadcast
    meeting = entries.join(ends.hint("merge"), "key").select("key", "node").distinct()
    met = checkpointed(meeting.join(first.select("node", "x"), "node").select("key", "node", "x"))
    remove_folder(docs.sparkSession, tables.folder)

    of = first.groupBy("fp").agg(F.min("node").alias("node"))
    copies = first.join(of.withColumnRenamed("node", "a"), "fp").select("a", F.col("node").alias("b")).filter("a <> b")
    near = links(of).join(of.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(of.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b")
    edges = checkpointed(copies.union(near.select("x", "y")))

    labels = connected(edges, met, _alike, lambda pairs: _verified(pairs, first, rows, id, text, words))
    labelled = first.join(labels, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    return described.join(labelled.join(least, "component").select("node", "component_id"), "node").select(id, "component_id")


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5) -> DataFrame:
    """The rows of ``docs`` that are first of their component; rows without an id stay."""
    gone = near_copies(docs, id, text, words).filter(F.col("component_id") < F.col(id)).select(id)
    return docs.join(gone, id, "left_anti").select(docs.columns)
