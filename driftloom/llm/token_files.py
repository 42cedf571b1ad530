"""Token files: ids of a tokenizer packed into the fewest bits that the vocabulary needs, in shards with block offsets.

``write`` sorts the documents by id over all tasks (ranges of ids, ties by text), encodes each text, appends an end id and
writes one shard for each range. A shard is

* blocks: ``BLOCK_IDS`` ids each (the last has fewer), id j of a block in bits j * width up to (j + 1) * width, lowest bit
  first, padded to whole bytes,
* the table of its documents (id and number of ids) as an Arrow stream,
* the byte offsets of the blocks, as little-endian unsigned 64-bit integers,
* a trailer of ``TRAILER`` bytes: ``MAGIC`` and big-endian unsigned 64-bit integers: ids, blocks, bytes of the document
  table, ids of a block, bits of an id, number of the shard.

One newline byte follows each block and the trailer, since shards are written by Spark's text writer: it takes bytes as
they are, works on every file system that Spark knows, and publishes a shard only when its task has ended, so that a
lost or repeated task leaves no half or double shard. A document lies in one shard; a shard holds whole ranges of ids, so
its documents precede those of the shards after it.

``read`` gives the documents back. ``Shard`` is for random access to a shard's bytes (a memory map, say): any range of
ids, any document, without reading the blocks before.

Texts are cut at ASCII white space and between words and marks, and each piece is encoded once in a while (``Words`` keeps
the ids of short pieces). That gives the tokenizer's own ids if its splitting never spans such a cut, drops white space, and
its normaliser ignores case, as in ``word_bpe_49k.json``; ``Words`` refuses vocabularies for which a probe shows otherwise.
Strings of special tokens in a text are ordinary text.

Cases: a null text counts as empty and has the end id alone; null ids come first; repeated rows are documents of their
own; an empty table makes a folder without documents. Other columns of the input are not written.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder, slices

#: Ids of a block, UTF-8 bytes of text of a shard (several ids a shard at least), bytes of text below which no task is added.
BLOCK_IDS, SHARD_BYTES, LEAST_BYTES = 1 << 16, 48 << 20, 1 << 20
MAGIC, TRAILER = b"idpack01", 56
#: Pieces kept by a worker, and their most bytes.
KEPT, SHORT = 3 << 17, 40
#: Bytes of a longer text that are cut into pieces at a time, and pieces encoded together.
CHUNK, TOGETHER = 1 << 20, 1 << 9
#: Text whose ids tell whether white space may be cut at.
PROBE = "It's 12 O'Clock.\tH\u0331a. x,y;Z! \u00c1\u00e9. 5:\u00f7? \u00d7! \u00d1x, \u00c1 e\u0301\n\n x y <|endoftext|>  \u03a3\u03a3 'll we 'll"
#: Marks that no match of the tokenizer's splitting joins to a letter or digit before.
MARKS = b".,;:!?"
#: Begins a character beyond U+00FF.
WIDE = re.compile(rb"[\xc4-\xff]")
NUMBERS = ("ids", "blocks", "table_bytes", "block_ids", "width", "shard")


def width_of(vocabulary: int) -> int:
    """The fewest bits that hold the ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Each id in ``width`` bits, lowest bit first."""
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id does not fit into {width} bits")
    bits = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack(data, width: int, start: int, stop: int) -> np.ndarray:
    """The ids start .. stop - 1 of packed ``data``; only the bytes that hold them are touched."""
    first, last = start * width // 8, (stop * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8)[first:last], bitorder="little")[start * width - 8 * first :]
    out = np.zeros((stop - start, 32), np.uint8)
    out[:, :width] = bits[: (stop - start) * width].reshape(-1, width)
    return np.packbits(out, axis=1, bitorder="little").view("<u4").ravel()


class Shard:
    """Random access to the bytes of a shard (bytes, a memory map, an Arrow buffer)."""

    def __init__(self, data):
        self.data = memoryview(data)
        raw = self.data[-TRAILER - 1 : -1]
        if bytes(raw[:8]) != MAGIC:
            raise ValueError("this is no shard of packed ids")
        self.ids, blocks, table_bytes, self.block_ids, self.width, self.number = struct.unpack(">6Q", raw[8:])
        end = len(self.data) - TRAILER - 1 - 8 * blocks
        self.offsets = np.frombuffer(self.data[end : end + 8 * blocks], "<u8").astype(np.int64)
        self._table = self.data[end - table_bytes : end]

    def read(self, start: int, stop: int) -> np.ndarray:
        """The ids at places start .. stop - 1 of the shard."""
        parts = [np.zeros(0, "<u4")]
        for b in range(start // self.block_ids, (stop + self.block_ids - 1) // self.block_ids if stop > start else 0):
            first = b * self.block_ids
            parts.append(unpack(self.data[int(self.offsets[b]) :], self.width, max(start - first, 0), min(stop - first, self.block_ids)))
        return np.concatenate(parts)

    def documents(self) -> tuple[pa.Array, np.ndarray]:
        """The documents' ids and where each begins; one past the last ends the places."""
        table = pa.ipc.open_stream(pa.py_buffer(self._table)).read_all()
        sizes = table.column("n").to_numpy()
        return table.column("id").combine_chunks(), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


class Words:
    """A tokenizer applied to pieces between ASCII white space; ids of short pieces are kept."""

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(raw.decode())
        self.tokenizer.encode_special_tokens = True
        # letters of U+0000 to U+00FF make one word; the model takes it as the splitting hands it on
        letters = [c for c in map(chr, range(256)) if c.isalpha() and c == c.lower()]
        self.letters = {ord(c): x[0][0] for c in letters if len(x := self.tokenizer.pre_tokenizer.pre_tokenize_str(c)) == 1}
        self.model = self.tokenizer.model
        self.kept: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}  # what was kept until there was too much
        whole = self.tokenizer.encode(PROBE, add_special_tokens=False).ids
        if np.frombuffer(self.encode([PROBE.encode()])[0], "<u4").tolist() != whole:
            raise ValueError("this tokenizer looks across white space")

    def _fill(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """The ids of pieces that are not kept; a mark after a letter or digit is a match of its own."""
        older = self.older
        made = {p: older[p] for p in pieces if p in older}
        marked = [p for p in pieces if p not in made and p[-1] in MARKS and p[-2:-1].isalnum()]
        new = {p for p in pieces if p not in made}.difference(marked)
        for p in {x for m in marked for x in (m[:-1], m[-1:])}:
            if p in self.kept or p in older:
                made[p] = self.kept[p] if p in self.kept else older[p]
            else:
                new.add(p)
        rest, model, letters = [], self.model.tokenize, self.letters
        for p in new:
            if p.isalpha():  # of ASCII
                made[p] = array("I", [t.id for t in model(p.decode())]).tobytes()
            elif not WIDE.search(p) and (word := p.decode(errors="replace")).isalpha() and letters.keys() >= set(map(ord, word)):
                made[p] = array("I", [t.id for t in model(word.translate(letters))]).tobytes()
            else:
                rest.append(p)
        for i in range(0, len(rest), TOGETHER):
            some = rest[i : i + TOGETHER]
            encoded = self.tokenizer.encode_batch_fast([p.decode(errors="replace") for p in some], add_special_tokens=False)
            made |= {p: array("I", e.ids).tobytes() for p, e in zip(some, encoded, strict=True)}
        made |= {p: made[p[:-1]] + made[p[-1:]] for p in marked}
        return made

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        split = [_pieces(t) for t in texts]
        missing = set().union(*split).difference(self.kept)
        if not missing:
            return [b"".join(map(self.kept.__getitem__, own)) for own in split]
        if len(self.kept) + len(missing) > KEPT:
            self.kept, self.older = {}, self.kept
            missing = set().union(*split)
        made = self._fill(missing)
        self.kept |= {p: i for p, i in made.items() if len(p) <= SHORT}
        now = self.kept if max(map(len, made)) <= SHORT else self.kept | made
        return [b"".join(map(now.__getitem__, own)) for own in split]

    def parts(self, text: bytes) -> Iterator[bytes]:
        """The ids of a long text, in parts."""
        at = 0
        while at < len(text):
            end = len(text) if len(text) - at <= CHUNK else _space(text, at + CHUNK)
            yield from self.encode([text[at:end]])
            at = end


def _pieces(text: bytes) -> list[bytes]:
    """Split at the six white space characters of ASCII; lower case where no combining mark can follow."""
    if text.isascii():
        return text.lower().split()
    if not WIDE.search(text):
        return text.decode(errors="replace").lower().encode().split()
    return [p.lower() if p.isascii() else p for p in text.split()]


def _space(text: bytes, at: int) -> int:
    """The place of the first white space from ``at`` on."""
    found = [i for c in b" \t\n\x0b\x0c\r" if (i := text.find(c, at)) >= 0]
    return min(found, default=len(text))


@lru_cache(maxsize=2)
def words(raw: bytes) -> Words:
    """One a worker process."""
    return Words(raw)


class _Writer:
    """Rows of a shard from the ids of its documents, in order."""

    def __init__(self, width: int, number: int, id_type: pa.DataType):
        self.width, self.number, self.id_type = width, number, id_type
        self.ids: list[pa.Array] = []
        self.sizes: list[np.ndarray] = []
        self.offsets: list[int] = []
        self.held: list[bytes] = []
        self.n_held = self.bytes = self.n = 0

    def block(self, data: bytes) -> bytes:
        packed = pack(np.frombuffer(data, "<u4"), self.width)
        self.offsets.append(self.bytes)
        self.bytes += len(packed) + 1
        self.n += len(data) // 4
        return packed

    def add(self, part: bytes) -> Iterator[bytes]:
        self.held.append(part)
        self.n_held += len(part)
        if self.n_held >= 4 * BLOCK_IDS:
            data = b"".join(self.held)
            full = len(data) - len(data) % (4 * BLOCK_IDS)
            for i in range(0, full, 4 * BLOCK_IDS):
                yield self.block(data[i : i + 4 * BLOCK_IDS])
            self.held, self.n_held = [data[full:]], len(data) - full

    def close(self) -> Iterator[bytes]:
        if self.n_held:
            yield self.block(b"".join(self.held))
        table = pa.table({"id": pa.chunked_array(self.ids, self.id_type), "n": np.concatenate(self.sizes)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        stream = sink.getvalue().to_pybytes()
        trailer = MAGIC + struct.pack(">6Q", self.n, len(self.offsets), len(stream), BLOCK_IDS, self.width, self.number)
        yield stream + np.array(self.offsets, "<u8").tobytes() + trailer


def _rows(parts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], ["value"])


def write(docs: DataFrame, folder: str, tokenizer: str, end: int, id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Write the documents' ids to ``folder`` (which must not exist), in ascending order of ``id``.

    ``tokenizer`` is the path of a file of the tokenizers library, which the driver reads; ``end`` follows each document."""
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        raw = f.read()
    width = width_of(max(words(raw).tokenizer.get_vocab_size(), end + 1))
    shared = spark.sparkContext.broadcast(raw)
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = min(spark.sparkContext.defaultParallelism, size // LEAST_BYTES)
    shards = int(max(1, size // shard_bytes + 1, tasks))
    order = ["id", "h", "text"]
    # ranges by id and hash, so that many rows of one id are split as well
    dealt = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(shards, "id", "h").sortWithinPartitions(*order)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, own, last = None, words(shared.value), np.array([end], "<u4").tobytes()
        for batch in slices(batches, "text"):
            writer = writer or _Writer(width, TaskContext.get().partitionId(), batch.column("id").type)
            sizes = np.zeros(batch.num_rows, np.int64)
            out: list[bytes] = []
            texts = [t.as_py() for t in batch.column("text").cast(pa.large_binary())]  # about a block, or one longer text
            for i, parts in enumerate(map(own.parts, texts) if len(texts) == 1 else ([x] for x in own.encode(texts))):
                for part in (*parts, last):
                    sizes[i] += len(part) // 4
                    out += writer.add(part)
            writer.ids.append(batch.column("id"))
            writer.sizes.append(sizes)
            if out:
                yield _rows(out)
        if writer:
            yield _rows(list(writer.close()))

    made = dealt.select("id", "text").mapInArrow(packed, "value binary")
    made.select(F.col("value").cast("string").alias("value")).write.option("compression", "none").text(folder)


def _number(name: str) -> Column:
    """A number of the trailer of a shard's ``content``."""
    at = F.length("content") - TRAILER + 8 * (1 + NUMBERS.index(name))  # the first byte is 1, and a newline ends the shard
    return F.conv(F.hex(F.substring("content", at, F.lit(8))), 16, 10).cast("long")


def _shards(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)


def read(spark: SparkSession, folder: str, id: str = "doc_id", id_type: str = "long") -> DataFrame:
    """(id, start, n_tokens, ids) of each document in ``folder``.

    ``ids`` are little-endian unsigned 32-bit integers, n_tokens their number, ``start`` the number of ids of all
    documents before it."""
    files = _shards(spark, folder)
    sizes = files.select(_number("shard").alias("shard"), _number("ids").alias("n"))
    before = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))  # a row for each shard

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                shard = Shard(content.as_buffer())
                ids, at = shard.documents()
                first = 0
                while first < len(ids):  # documents of about as many ids as a few blocks
                    last = max(first + 1, int(np.searchsorted(at, at[first] + 8 * BLOCK_IDS, "right")) - 1)
                    data = pa.py_buffer(shard.read(int(at[first]), int(at[last])).tobytes())
                    offsets = pa.py_buffer((4 * (at[first : last + 1] - at[first])).astype(np.int64).tobytes())
                    values = pa.Array.from_buffers(pa.large_binary(), last - first, [None, offsets, data]).cast(pa.binary())
                    columns = [np.full(last - first, shard.number), at[first:last], np.diff(at[first : last + 1])]
                    yield pa.RecordBatch.from_arrays([ids[first:last], *map(pa.array, columns), values], ["id", "shard", "place", "n_tokens", "ids"])
                    first = last

    rows = files.select("content").mapInArrow(unpacked, f"id {id_type}, shard long, place long, n_tokens long, ids binary")
    rows = rows.join(F.broadcast(before), "shard")  # two numbers for each shard, so that the ids need not move
    return rows.select(F.col("id").alias(id), (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids")


def round_trip(docs: DataFrame, tokenizer: str, end: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write token files to a new folder in the shared folder and read them back; the files are the result and stay."""
    folder = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, folder, tokenizer, end, id, text)
    return read(docs.sparkSession, folder, id, docs.schema[id].dataType.simpleString())
