"""What the text operators share: table access, lineage cuts, batches of UTF-8 bytes as numpy arrays."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task's Python side works on at a time (one longer document is a block of its own).
BLOCK_BYTES = 1 << 20
#: Java regular expression of one separator between words.
SPACE_RE = r"[\x20\x09-\x0D]"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII upper case to lower case, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Two primes below 2^31, for each the base of its polynomial.
PRIMES = ((2147483647, 1575931494), (2147483629, 1103515245))
#: Bytes whose products with powers below 2^31 have a sum below 2^64.
WIDE = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``: how the contracts split rows into folds."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % modulus


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Only where the session names none and runs on this machine alone (tests) is a folder of this machine set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage: Spark's cleaner then removes the shuffle files of results that nothing
    refers to any more, instead of whenever the heap happens to fill."""
    for _ in range(2):  # Python's references are handed back by a thread of its own
        gc.collect()
        time.sleep(0.3)
        spark.sparkContext._jvm.System.gc()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Tables:
    """Parquet tables that cut lineages, in a folder of their own within the shared folder.

    ``drop`` deletes those that no later result is read from."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.made: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.made)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.made.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table_, path in self.made:
            if any(table_ is t for t in tables):
                remove_folder(self.spark, path)


#: Numbers of 64 bits in a filter of keys, a power of two.
FILTER_WORDS = 1 << 18


def likely(rows: DataFrame, key: str, wanted: DataFrame, of: str) -> DataFrame:
    """The rows whose ``key`` may be in the column ``of`` of ``wanted``: all that are, and as many others as hashes fall together.

    A bit for each hash of ``wanted``, FILTER_WORDS numbers at most, goes to the tasks, so that a join moves few other rows."""

    def placed(c: str):
        h = F.xxhash64(c)
        return F.shiftrightunsigned(h, 64 - (FILTER_WORDS.bit_length() - 1)), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))

    (w, b), (at, bit) = placed(of), placed(key)
    word, bits = unused("word", rows), unused("bits", rows)
    words = wanted.select(w.alias(word), b.alias("b")).groupBy(word).agg(F.bit_or("b").alias(bits))
    return rows.withColumn(word, at).join(F.broadcast(words), word).filter(F.col(bits).bitwiseAND(bit) != 0).select(rows.columns)


def unused(stem: str, *frames: DataFrame) -> str:
    """A column name that no frame has, whatever the case."""
    taken = {c.lower() for f in frames for c in f.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def others(df: DataFrame, *made: str) -> list[str]:
    """The columns of ``df`` but for those named like ``made``, whatever the case."""
    gone = {m.lower() for m in made}
    return [c for c in df.columns if c.lower() not in gone]


def _labelled(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(id, text, h) of the texts and (id, label) of the labels; several labels of one id count as their maximum, null texts
    as empty."""
    wanted = labels.filter(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("id", "text"))
    return rows, wanted


def labelled_sample(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, most: int, seed: str) -> DataFrame:
    """(h, text, label) of at most ``most`` different labelled texts, drawn by hashes; several labels of one id count as their
    maximum, null texts as empty, and equal texts of one id once.

    Labels meet the hashes of the texts before any is drawn, so labels without a text take no place; texts do not move
    for that."""
    rows, wanted = _labelled(docs, labels, id, text, label)
    met = rows.select("id", "h").join(wanted, "id").select("h", "label").distinct()
    drawn = checkpointed(met.orderBy(F.xxhash64(F.lit(seed), F.col("h")), "h", "label").limit(most))  # bounded by ``most``
    return checkpointed(rows.select("h", "text").join(F.broadcast(drawn), "h").dropDuplicates(["h"]))


def labelled(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str) -> DataFrame:
    """(h, text, label) of all different labelled texts, with the cases of ``labelled_sample``."""
    rows, wanted = _labelled(docs, labels, id, text, label)
    # equal texts of one id are where the join has brought them
    return checkpointed(rows.join(wanted, "id").dropDuplicates(["id", "h"]).select("h", "text", "label"))


def fields(df: DataFrame, *names: str) -> str:
    """DDL of the named columns of ``df``."""
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


class Block:
    """Some texts as one array of bytes. ``offsets[i]:offsets[i + 1]`` is text i; null is empty."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        raw = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
        data = texts.buffers()[2]
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data = whole[raw[0] : raw[-1]]
        self.offsets = raw - raw[0]
        self.n = n

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Block:
        """A block of these bytes, cut at ``offsets``."""
        out = cls.__new__(cls)
        out.data, out.offsets, out.n = data, offsets, len(offsets) - 1
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each word, in order."""
        space = _SPACE[self.data]
        starts = ~space
        if len(starts):
            first = self.offsets[:-1][np.diff(self.offsets) > 0]
            begins = np.zeros(len(space), bool)
            begins[first] = True
            starts[1:] &= space[:-1] | begins[1:]
            stops = ~space
            stops[:-1] &= space[1:] | begins[1:]
            s, e = np.flatnonzero(starts), np.flatnonzero(stops) + 1
        else:
            s = e = np.zeros(0, np.int64)
        return s, e, np.searchsorted(self.offsets, s, "right") - 1


#: Each forgets what an operator's tasks keep in their worker for its tasks to come.
FORGET: list[Callable[[], None]] = []


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about BLOCK_BYTES of text.

    Workers are used again by whatever comes next, so what other operators left in this one goes first."""
    for forget in FORGET:
        forget()
    pa.default_memory_pool().release_unused()
    for batch in batches:
        column = batch.column(text).cast(pa.large_string()).fill_null("")
        if not len(column):
            continue
        run = np.cumsum(np.diff(np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)))
        at = 0
        while at < len(column):
            limit = (run[at - 1] if at else 0) + BLOCK_BYTES
            end = max(at + 1, int(np.searchsorted(run, limit, "right")))
            yield batch.slice(at, end - at)
            at = end


def blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, Block]]:
    for part in slices(batches, text):
        yield part, Block(part.column(text))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _grown(base: int, prime: int, n: int) -> np.ndarray:
    """The first n powers of the base modulo the prime, by doubling."""
    out = np.ones(n, np.uint64)
    done, step = 1, base
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step) % np.uint64(prime)
        done, step = 2 * done, step * step % prime
    return out


def _powers(prime: int, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept for the blocks to come."""
    kept = _POWERS.get(prime)
    if kept is None or len(kept[0]) < n:
        size = max(n, BLOCK_BYTES + BLOCK_BYTES // 4)
        kept = _POWERS[prime] = _grown(base, prime, size), _grown(pow(base, -1, prime), prime, size)
    return kept[0][:n], kept[1][:n]


class SpanHasher:
    """64-bit hashes of data[start:end], equal for equal bytes: two polynomials modulo primes, from prefix sums.

    Different bytes of n each have the same hash with a chance of some (n / 2^31)^2, so equal hashes are no proof of equal
    bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.parts = []
        for prime, base in PRIMES:
            up, down = _powers(prime, base, n + 1)
            total = np.zeros(n + 1, np.uint64)
            terms = (data.astype(np.uint64) + np.uint64(1)) * up[:n]
            if n > WIDE:  # sums of more terms could run over
                terms %= np.uint64(prime)
            np.cumsum(terms, out=total[1:])
            self.parts.append((total, down, np.uint64(prime)))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        (t1, d1, p1), (t2, d2, p2) = self.parts
        first = (t1[ends] - t1[starts]) % p1 * d1[starts] % p1
        second = (t2[ends] - t2[starts]) % p2 * d2[starts] % p2
        return mixed((first << np.uint64(31) | second) + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def rolling(self, size: int) -> np.ndarray:
        """The hashes of all spans of one size, in order; those of ``__call__``."""
        (t1, d1, p1), (t2, d2, p2) = self.parts
        n = len(t1) - size
        first = (t1[size:] - t1[:n]) % p1 * d1[:n] % p1
        second = (t2[size:] - t2[:n]) % p2 * d2[:n] % p2
        return mixed((first << np.uint64(31) | second) + np.uint64(size * 0xC2B2AE3D27D4EB4F % (1 << 64)))


class Lookup:
    """Values by 64-bit key: keys sorted, found through a table over their leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.bits = min(24, max(8, len(keys).bit_length() + 1))
        edges = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.start = np.append(np.searchsorted(self.keys, edges), len(keys)).astype(np.int32)
        self.most = int(np.diff(self.start).max())

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` that are keys, and their values."""
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.start[slot], self.start[slot + 1]
        where, which = [], []
        left = np.flatnonzero(at < end)
        for j in range(self.most):
            if j:
                left = left[at[left] + j < end[left]]
            k = at[left] + j
            hit = self.keys[k] == hashes[left]
            where.append(left[hit])
            which.append(k[hit])
        if not where:
            return np.zeros(0, np.int64), self.values[:0]
        w = np.concatenate(where)
        return w, self.values[np.concatenate(which)]
