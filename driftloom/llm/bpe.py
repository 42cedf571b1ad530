"""Byte-level BPE encoding and decoding.

Encoding: the merge ranks become a transducer over bytes. By the locality of BPE, a tokenisation is the one that
the merges give exactly if each two neighbouring tokens are (``Ranks.holds``). So a reader of the bytes so far
needs only the places where a token may have begun: for each, how far into the vocabulary's trie the bytes since
then lead. A set of these is one deterministic state; states and their arcs are made when first reached. An arc's
output is the token that ends there and holds next to the one before it. A token is emitted once the tokenisations up to
all places that are still open agree on it, looked for every ``STEP`` bytes; those places reach back by at most the
longest token's length. Pieces run through the transducer side by side.

Decoding: token bytes are joined block by block and a table-driven incremental UTF-8 machine carries a character that a
block cuts over to the next block.

Cases: a null or empty text has no ids and decodes to the empty text; ids out of range raise ValueError; bytes that
are no UTF-8 decode to U+FFFD, one for each maximal part, as the standard says; repeated rows are encoded alike; an
empty table gives an empty table. Input columns are kept; those named like the output are replaced.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, filterfalse, islice
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FORGET

#: Pieces in each of a worker's two memories, and states of its transducer; what is full starts anew.
MOST_PIECES, MOST_STATES = 200_000, 150_000
#: Rows of a batch that are Python objects at a time.
ROWS = 256


class Ranks:
    """A rank file: token bytes and, for each token, the pair of which the merges make it."""

    def __init__(self, data: bytes):
        pairs = [line.split() for line in data.splitlines() if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.tokens: dict[int, bytes] = {v: k for k, v in self.rank.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.joined: dict[tuple[int, int], int] = {}
        rank = self.rank
        for t in sorted(self.tokens):  # in rank order, parts come before what is made of them
            text = self.tokens[t]
            for i in range(1, len(text)):
                a, b = rank.get(text[:i]), rank.get(text[i:])
                if a is not None and b is not None and a < t and b < t and self.holds(a, b):
                    self.left[t], self.right[t] = a, b
                    self.joined[a, b] = t
                    break
        self.sizes = np.zeros(max(self.tokens) + 1, np.int64)
        for t, text in self.tokens.items():
            self.sizes[t] = len(text)
        self.pairs = Pairs(self)
        # only tokens that merges can reach take part; the others match whole pieces only
        self.trie: list[dict[int, int]] = [{}]
        self.depth = [0]
        self.ends: dict[int, int] = {}
        self.size = {t: len(text) for t, text in self.tokens.items()}
        for text, t in rank.items():
            if len(text) > 1 and t not in self.left:
                continue
            node = 0
            for depth, b in enumerate(text, 1):
                node = self.trie[node].setdefault(b, len(self.trie))
                if node == len(self.trie):
                    self.trie.append({})
                    self.depth.append(depth)
            self.ends[node] = t

    def holds(self, a: int, b: int) -> bool:
        """Whether the merges leave the boundary between a and b alone.

        The merges that built a's right edge and b's left edge are undone, latest first. A merge across the boundary
        would have come about if the two tokens that faced each other make one of lower rank than the merge that
        replaced either of them (equal ranks go to the left)."""
        left, right, joined = self.left, self.right, self.joined
        until = 1 << 62
        while True:
            made = joined.get((a, b))
            if made is not None and made < until:
                return False
            if a > b:
                if a not in left:
                    if b not in left:
                        return True
                    until, b = b + 1, left[b]
                else:
                    until, a = a, right[a]
            elif b not in left:
                if a not in left:
                    return True
                until, a = a, right[a]
            else:
                until, b = b + 1, left[b]


class Transducer:
    """Bytes in, tokens out. A state is the set of the trie nodes that the latest bytes may lead to, one for each place
    where a token may have begun; states and arcs are made when first reached, so this is the trie's nondeterministic
    automaton, determinised lazily. An arc names the tokens that may end with its byte; of these exactly one holds
    next to the token before it. ``encode`` emits tokens once the open places have a common boundary behind them."""

    #: Bytes between two looks for what can be emitted.
    STEP = 64

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple[int, ...]] = [(0,)]
        self.number = {self.states[0]: 0}
        # arcs as arrays: number by state and byte; next state, ending tokens and their sizes by number
        self.arcs = 0
        self.numbers = np.full((1 << 10, 256), -1, np.int32)
        self.to = np.zeros(1 << 12, np.int32)
        self.tokens = np.zeros((1 << 12, 4), np.int32)
        self.sizes = np.zeros((1 << 12, 4), np.int32)

    def _arc(self, state: int, byte: int) -> None:
        trie, ends, depth = self.ranks.trie, self.ranks.ends, self.ranks.depth
        reached = [to for node in self.states[state] if (to := trie[node].get(byte)) is not None]
        ending = [(ends[node], depth[node]) for node in reached if node in ends]
        key = (*(node for node in reached if trie[node]), 0)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        number, self.arcs = self.arcs, self.arcs + 1
        if len(self.states) > len(self.numbers):
            self.numbers = np.concatenate([self.numbers, np.full_like(self.numbers, -1)])
        if number == len(self.to):
            self.to, self.tokens, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.to, self.tokens, self.sizes))
        if (more := len(ending) - self.tokens.shape[1]) > 0:
            self.tokens, self.sizes = np.pad(self.tokens, ((0, 0), (0, more))), np.pad(self.sizes, ((0, 0), (0, more)))
        self.numbers[state, byte] = number
        self.to[number] = to
        self.tokens[number, : len(ending)] = [t for t, _ in ending]
        self.sizes[number, : len(ending)] = [k for _, k in ending]

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The tokens of each piece, as little-endian 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in pieces]
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        rows = np.argsort(-length, kind="stable")
        rows = rows[length[rows] > 0]
        state = np.zeros(len(rows), np.int32)
        # of each piece: the last token emitted (-1 before any), then the token that ends at each byte not yet settled
        held = [np.full(1, -1, np.int32)] * len(rows)
        done = 0
        while len(rows):
            step = min(self.STEP, int(length[rows[0]]) - done)
            if not done and len(self.states) > MOST_STATES:
                self._reset()
            reach = max(map(len, held))
            begin = np.fromiter((reach - len(h) for h in held), np.int64, len(rows))
            last = np.zeros((reach + step, len(rows)), np.int32)
            for i in np.flatnonzero(begin < reach - 1).tolist():
                last[begin[i] : reach, i] = held[i]
            alike = np.flatnonzero(begin == reach - 1)
            last[reach - 1, alike] = [held[i][0] for i in alike.tolist()]
            data = np.frombuffer(b"".join(pieces[i][done : done + step].ljust(step, b"\0") for i in rows.tolist()), np.uint8).reshape(len(rows), step)
            left_over = length[rows] - done
            for j in range(step):
                n = int(np.searchsorted(-left_over, -j, "left"))
                self._advance(data[:n, j], state, last, reach + j, begin)
            ended = left_over <= step
            self._emit(rows[ended], last[:, ended], reach + left_over[ended], begin[ended], out)
            going = np.flatnonzero(~ended)
            following = []
            for i in going.tolist():
                column = last[begin[i] :, i]
                settled = self._settled(int(state[i]), column)
                if settled:
                    ids = self._back(column, settled)
                    out[rows[i]].append(ids[::-1].tobytes())
                    column = np.concatenate([ids[:1], column[settled + 1 :]])
                following.append(column)
            held, rows, state, done = following, rows[going], state[going], done + step
        return [b"".join(x) for x in out]

    def _advance(self, byte: np.ndarray, state: np.ndarray, last: np.ndarray, at: int, begin: np.ndarray) -> None:
        """Read one byte of each of the first pieces: new states, and in row ``at`` of ``last`` the tokens that end there."""
        n = len(byte)
        arc = self.numbers[state[:n], byte]
        if len(new := np.flatnonzero(arc < 0)):
            for key in np.unique(state[new].astype(np.int64) << 8 | byte[new]).tolist():
                self._arc(key >> 8, key & 255)
            arc = self.numbers[state[:n], byte]
        state[:n] = self.to[arc]
        left, c = np.arange(n), 0
        while len(left):
            token, before = self.tokens[arc[left], c], at - self.sizes[arc[left], c]
            past = last[np.maximum(before, 0), left]
            # a token that begins before what is settled is none; the first of a piece has no other before it
            holds = (before >= begin[left]) & ((past < 0) | self.ranks.pairs.hold(np.maximum(past, 0), token))
            last[at, left[holds]] = token[holds]
            left, c = left[~holds], c + 1

    def _emit(self, rows: np.ndarray, last: np.ndarray, end: np.ndarray, begin: np.ndarray, out: list[list[bytes]]) -> None:
        """Hand on the tokens of the pieces that end."""
        size = self.ranks.sizes
        at, which, found, owners = end - 1, np.arange(len(rows)), [], []
        while len(which):
            token = last[at[which], which]
            found.append(token)
            owners.append(which)
            at[which] -= size[token]
            which = which[at[which] > begin[which]]
        if found:
            owner, token = np.concatenate(owners)[::-1], np.concatenate(found)[::-1]
            by = np.argsort(owner, kind="stable")
            ids = token[by].astype("<u4").tobytes()
            cut = (4 * np.searchsorted(owner[by], np.arange(len(rows) + 1))).tolist()
            for k, i in enumerate(rows.tolist()):
                out[i].append(ids[cut[k] : cut[k + 1]])

    def _back(self, column: np.ndarray, at: int) -> np.ndarray:
        """The tokens of the bytes up to place ``at``, latest first."""
        found, size = [], self.ranks.sizes
        while at > 0:
            found.append(column[at])
            at -= int(size[column[at]])
        return np.array(found, "<u4")

    def _settled(self, state: int, column: np.ndarray) -> int:
        """The latest boundary that the tokenisations up to all open places share."""
        size, depth = self.ranks.sizes, self.ranks.depth
        common: set[int] | None = None
        for node in self.states[state]:
            at, seen = len(column) - 1 - depth[node], set()
            while at > 0:
                seen.add(at)
                at -= int(size[column[at]])
            common = seen if common is None else common & seen
        return max(common or {0})


class Pairs:
    """Whether the boundary between two tokens holds, remembered in a table of fixed size that newer pairs overwrite."""

    BITS = 20

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.values = np.zeros(1 << self.BITS, bool)

    def hold(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        slot = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).view(np.int64)
        out = self.values[slot]
        if len(new := np.flatnonzero(self.keys[slot] != key)):
            fresh, at = np.unique(key[new], return_inverse=True)
            value = np.fromiter((self.ranks.holds(k >> 20, k & 0xFFFFF) for k in fresh.tolist()), bool, len(fresh))
            out[new] = value[at]
            where = slot[new]
            self.keys[where], self.values[where] = key[new], out[new]
        return out


class Pieces(dict):
    """Piece of text to its ids as little-endian 32-bit integers.

    A full memory becomes the old one; pieces met again move from it to the new one, so that frequent pieces stay."""

    #: Bytes of the longest piece that is remembered for other texts.
    REMEMBERED = 64

    def __init__(self, ranks: Ranks):
        super().__init__()
        self.ranks, self.transducer, self.old, self.long = ranks, Transducer(ranks), {}, {}

    def prepare(self, lists: list[list[str]]) -> None:
        """Encode the pieces of the lists that are not known yet, side by side."""
        if len(self) >= MOST_PIECES:
            self.old = dict(self)
            self.clear()
        missing = set(filterfalse(self.__contains__, chain.from_iterable(lists)))
        again = missing & self.old.keys()
        for p in again:
            self[p] = self.old[p]
        new = []
        for p in missing - again:
            raw = p.encode()
            whole = self.ranks.rank.get(raw)
            if whole is not None:
                self[p] = pack("<I", whole)
            else:
                new.append((p, raw))
        self.long = {}
        for (p, raw), ids in zip(new, self.transducer.encode([raw for _, raw in new]), strict=True):
            (self if len(raw) <= self.REMEMBERED else self.long)[p] = ids

    def __missing__(self, piece: str) -> bytes:
        return self.long[piece]


def _utf8_table() -> tuple[list[list[int]], list[int]]:
    """Next states by state and byte, and the bits of a first byte that belong to the character.

    States: 0 between characters, 1 to 3 so many more bytes, 4 to 7 after the bytes that narrow the next one (E0, ED, F0,
    F4), 8 no UTF-8."""
    table = [[8] * 256 for _ in range(8)]
    bits = [0] * 256
    for byte in range(256):
        if byte < 0x80:
            table[0][byte], bits[byte] = 0, byte
        elif 0xC2 <= byte < 0xE0:
            table[0][byte], bits[byte] = 1, byte & 31
        elif 0xE0 <= byte < 0xF0:
            table[0][byte], bits[byte] = {0xE0: 4, 0xED: 5}.get(byte, 2), byte & 15
        elif 0xF0 <= byte < 0xF5:
            table[0][byte], bits[byte] = {0xF0: 6, 0xF4: 7}.get(byte, 3), byte & 7
    for byte in range(0x80, 0xC0):
        table[1][byte], table[2][byte], table[3][byte] = 0, 1, 2
        table[4][byte] = 1 if byte >= 0xA0 else 8
        table[5][byte] = 1 if byte < 0xA0 else 8
        table[6][byte] = 2 if byte >= 0x90 else 8
        table[7][byte] = 2 if byte < 0x90 else 8
    return table, bits


class Utf8Machine:
    """Incremental UTF-8 by a table of states: ``feed`` returns the characters that are complete, ``end`` what a cut text
    leaves. A maximal part that no character begins with becomes U+FFFD.

    Stretches that are well-formed from one character's start to another's end go through Python's own decoder."""

    TABLE, BITS = _utf8_table()

    def __init__(self) -> None:
        self.state, self.value = 0, 0

    def _run(self, data: bytes, out: list[str]) -> None:
        table, state, value = self.TABLE, self.state, self.value
        for byte in data:
            to = table[state][byte]
            if to == 8 and state:  # the part before is broken off; the byte begins anew
                out.append("\ufffd")
                state = 0
                to = table[0][byte]
            if to == 8:
                out.append("\ufffd")
                state = 0
                continue
            value = value << 6 | byte & 63 if state else self.BITS[byte]
            state = to
            if not state:
                out.append(chr(value))
        self.state, self.value = state, value

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        start = 0
        while self.state and start < len(data):
            self._run(data[start : start + 1], out)
            start += 1
        end = len(data)  # the last character may be open
        while end > start and len(data) - end < 3 and data[end - 1] & 0xC0 == 0x80:
            end -= 1
        end = max(start, end - 1)
        try:
            out.append(data[start:end].decode())
        except UnicodeDecodeError:
            self._run(data[start:end], out)
        self._run(data[end:], out)
        return "".join(out)

    def end(self) -> str:
        out, self.state = "\ufffd" if self.state else "", 0
        return out


class Codec:
    #: Ids that the decoder takes at a time, characters that are encoded together.
    STEP, GROUP = 1 << 15, 1 << 20

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = Ranks(ranks)
        self.pieces = Pieces(self.ranks)
        self.pattern = regex.compile(pattern)
        # the bytes of all tokens in one array, and where each begins (one past the end: no such token)
        self.letters = np.frombuffer(b"".join(self.ranks.tokens[i] for i in sorted(self.ranks.tokens)), np.uint8)
        self.places = np.cumsum(self.ranks.sizes) - self.ranks.sizes

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; texts are taken together up to GROUP characters, longer ones piecewise."""
        out: list[bytes] = []
        held: list[list[str]] = []
        size = 0
        for text in texts:
            if len(text) > self.GROUP:
                self._flush(held, out)
                found, parts = (m[0] for m in self.pattern.finditer(text)), []
                while some := list(islice(found, self.GROUP >> 2)):
                    self._flush([some], parts)
                out.append(b"".join(parts))
                size = 0
                continue
            held.append(self.pattern.findall(text) if not self.pattern.groups else [m[0] for m in self.pattern.finditer(text)])
            size += len(text)
            if size > self.GROUP:
                self._flush(held, out)
                size = 0
        self._flush(held, out)
        return out

    def _flush(self, held: list[list[str]], out: list[bytes]) -> None:
        self.pieces.prepare(held)
        out += [b"".join(map(self.pieces.__getitem__, found)) for found in held]
        held.clear()

    def decode_bytes(self, ids: bytes) -> Iterator[bytes]:
        at = np.frombuffer(ids, "<u4")
        if len(at) and (int(at.max()) >= len(self.places) or not self.ranks.sizes[at].all()):
            raise ValueError("there are ids without a token")
        for i in range(0, len(at), self.STEP):
            ids = at[i : i + self.STEP]
            size = self.ranks.sizes[ids]
            end = np.cumsum(size)
            yield self.letters[np.repeat(self.places[ids] - (end - size), size) + np.arange(end[-1])].tobytes()

    def decode(self, ids: bytes) -> str:
        machine = Utf8Machine()
        return "".join([machine.feed(x) for x in self.decode_bytes(ids)]) + machine.end()


@lru_cache(maxsize=2)
def codec(ranks: bytes, pattern: str) -> Codec:
    """One a worker process, as loading a vocabulary takes about a second."""
    gc.set_threshold(500_000, 50, 1000)  # the states are many small tuples without cycles
    return Codec(ranks, pattern)


FORGET.append(codec.cache_clear)


def _rank_file(path: str):
    """The rank file as a broadcast, so that only the driver opens it; it is some megabytes."""
    with open(path, "rb") as f:
        return SparkSession.active().sparkContext.broadcast(f.read())


def _encoder(path: str, pattern: str):
    ranks = _rank_file(path)

    @F.arrow_udf(T.BinaryType())
    def encode_text(texts: pa.Array) -> pa.Array:
        encode = codec(ranks.value, pattern).encode
        # a few rows at a time, so that not all texts of a batch are Python strings at once
        parts = [pa.array(encode([t or "" for t in texts.slice(i, ROWS).to_pylist()]), pa.binary()) for i in range(0, len(texts), ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    return encode_text


def _decoder(path: str, pattern: str):
    ranks = _rank_file(path)

    @F.arrow_udf(T.StringType())
    def decode_ids(ids: pa.Array) -> pa.Array:
        decode = codec(ranks.value, pattern).decode
        parts = [pa.array([decode(x or b"") for x in ids.slice(i, ROWS).to_pylist()], pa.string()) for i in range(0, len(ids), ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return decode_ids


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the ids of ``text`` as one binary value of little-endian unsigned 32-bit integers."""
    return docs.withColumn(ids, _encoder(path, pattern)(F.col(text)))


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of ``ids``."""
    return encoded.withColumn(text, _decoder(path, pattern)(F.col(ids)))


def n_ids(ids: str = "ids") -> Column:
    return (F.octet_length(F.col(ids)) / 4).cast("long")
