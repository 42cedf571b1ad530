"""Phrases whose words occur together more often than their parts would by chance, mined by pivots.

Every phrase (of 2 to ``LONGEST`` words) belongs to its rarest word, its pivot. Each place of a text sends its word, as
pivot, what surrounds it: up to four words on either side, as far as they are not rarer than the pivot (a rarer word would
own the phrase) and reach the least count (a phrase is no more frequent than its words). Of a pivot's several places in
a phrase the leftmost owns it. So the fragments that reach a pivot hold each occurrence of its phrases just once, and a
pivot's phrases are counted where its fragments meet, growing from the pivot word by word and dropping what falls below
the least count on the way.

Equal fragments of a block of text are sent once, with a count. Fragments of a word with more than ``SPLIT`` occurrences
are dealt over several groups by their content; those groups keep all counts, which are summed by phrase afterwards.

Words are numbered by their counts, the most frequent first. Up to ``AT_HAND`` numbered words are sent to all tasks. If
there are more of the least count, others are numbered by a 64-bit hash, beyond the numbered ones, and count as rarer than
all of those; the seed is one under which no word of the least count shares its number with another word (checked over
all words), so numbers tell words apart. Phrases of such words are found like all others; only fragments of words
below the least count are then sent in vain.

Cases: a null text counts as empty; a null language counts as ``und``; repeated rows count each; ids play no part; an
empty table gives an empty result; ties of score and count go by the phrase's bytes. Further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, Tables, slices

LONGEST, LEAST, MOST = 5, 100, 2000
SIDE = LONGEST - 1
#: Words sent to all tasks (some 110 bytes each in a worker), occurrences of a word from which its fragments are split.
AT_HAND, SPLIT = 1 << 20, 200_000
#: Different words held by a task before it hands on their counts; fragments that are mined together.
HELD, TOGETHER = 1 << 18, 1 << 19
#: Groups that pick the first rows of each language before they meet.
GROUPS = 64
#: What ends a piece; a full stop stands for all of them, as it can be in no word.
ENDS = b".,;:!?\n\x0b\x0c\r"
_ENDS = bytes(ord(".") if c in ENDS else c for c in range(256))


def _tokens(text: bytes) -> bytes:
    """The lower-case text with each end of a piece as a word of its own."""
    return text.lower().translate(_ENDS).replace(b".", b" . ")


def _stretches(data: bytes) -> Iterator[tuple[list[bytes], int, int]]:
    """(words, first, last) of stretches of a text of about a block each; places first .. last - 1 are the stretch's own,
    up to SIDE words on either side come with it."""
    before: list[bytes] = []
    own: list[bytes] | None = None
    at = 0
    while at < len(data) or own is not None:
        after: list[bytes] = []
        while at < len(data) and len(after) < SIDE:  # the next stretch, of some words at least
            end = len(data) if len(data) - at <= BLOCK_BYTES else data.find(b" ", at + BLOCK_BYTES)
            end = len(data) if end < 0 else end
            after += data[at:end].split()
            at = end
        if own is not None:
            yield before + own + after[:SIDE], len(before), len(before) + len(own)
            before = (before + own)[-SIDE:]
        own = after or None


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[tuple[list[bytes], int, int]]]]:
    """For each language of a small batch the stretches of its texts; short texts are joined."""
    texts = batch.column("text").cast(pa.large_binary())
    of: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
        if text.is_valid:
            of.setdefault(lang, []).append(_tokens(text.as_py()))
    for lang, parts in of.items():
        yield lang, list(_stretches(b" . ".join(parts)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def rows() -> pa.RecordBatch:
        langs, words = [k[0] for k in held], [k[1] for k in held]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["lang", "word", "c"])

    for batch in slices(batches, "text"):
        for lang, stretches in _by_language(batch):
            for words, first, last in stretches:
                own = Counter(words[first:last])
                own.pop(b".", None)
                held.update({(lang, w): c for w, c in own.items()})
                if len(held) > HELD:
                    yield rows()
                    held.clear()
    if held:
        yield rows()


def hashed(seed: int, lang: str, word: bytes) -> int:
    """The number of a word that is not sent to all tasks; Spark's xxhash64 of the three, of which 62 bits count."""
    h = 42
    for x in (str(seed).encode(), lang.encode(), word):
        h = xxhash.xxh64_intdigest(x, h)
    return AT_HAND + (h >> 2)


class _Numbers(dict):
    """Numbers of one language's words; -1 for words below the least count if all others are known."""

    def __init__(self, lang: str, known: dict[bytes, int], seed: int | None):
        super().__init__(known)
        self.lang, self.seed = lang, seed
        self[b"."] = -1

    def __missing__(self, word: bytes) -> int:
        return -1 if self.seed is None else hashed(self.seed, self.lang, word)


def fragments(ids: np.ndarray, first: int, last: int) -> np.ndarray:
    """A row of 2 * SIDE + 1 numbers for each place first .. last - 1 whose word owns a phrase; the word stands in the
    middle, -1 where the fragment ends."""
    wide = np.concatenate((np.full(SIDE, -1), ids, np.full(SIDE, -1)))
    at = np.arange(first, last) + SIDE
    at = at[wide[at] >= 0]
    out = np.full((len(at), 2 * SIDE + 1), -1, np.int64)
    own = out[:, SIDE] = wide[at]
    for side in (-1, 1):
        alive = np.arange(len(at))
        for k in range(1, SIDE + 1):
            x = wide[at[alive] + side * k]
            alive = alive[(x >= 0) & (x <= own[alive] if side > 0 else x < own[alive])]
            out[alive, SIDE + side * k] = wide[at[alive] + side * k]
    return out[(out[:, SIDE - 1] >= 0) | (out[:, SIDE + 1] >= 0)]


def _distinct(rows: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different rows and how often each occurs."""
    # the pivot first, so that neighbours share it and compress well
    order = np.lexsort(rows.T[[*range(2 * SIDE, SIDE, -1), *range(SIDE - 1, -1, -1), SIDE]]) if len(rows) else np.zeros(0, np.int64)
    rows = rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    starts = np.flatnonzero(new)
    ones = np.ones(len(rows), np.int64) if counts is None else counts[order]
    return rows[starts], np.add.reduceat(ones, starts) if len(starts) else ones


def _binary(rows: np.ndarray, counts: np.ndarray, kind: str) -> pa.Array:
    """Each row as integers of one kind: count * (SIDE + 1) + words before the pivot, then the words but for the pivot."""
    wide = rows.copy()
    wide[:, SIDE] = -1
    wide = np.column_stack((counts * (SIDE + 1) + (rows[:, :SIDE] >= 0).sum(axis=1), wide))
    mask = wide >= 0
    flat = wide[mask].astype(kind)
    sizes = np.concatenate(([0], np.cumsum(mask.sum(axis=1)) * flat.itemsize)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(sizes.tobytes()), pa.py_buffer(flat.tobytes())]).cast(pa.binary())


def _unpacked(fragment: pa.Array, pivot: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The rows and counts of ``_binary``."""
    fragment = fragment.cast(pa.large_binary())
    size = np.dtype(kind).itemsize
    offsets = np.frombuffer(fragment.buffers()[1], np.int64, len(fragment) + 1, fragment.offset * 8) // size
    flat = np.frombuffer(fragment.buffers()[2], kind).astype(np.int64)
    head = flat[offsets[:-1]]
    row = np.repeat(np.arange(len(fragment)), np.diff(offsets) - 1)
    inside = np.ones(offsets[-1] - offsets[0], bool)
    inside[offsets[:-1] - offsets[0]] = False
    k = np.flatnonzero(inside)  # words in order; those from the pivot's place on stand one further
    place = k - (offsets[row] - offsets[0]) - 1
    before = head[row] % (SIDE + 1)
    rows = np.full((len(fragment), 2 * SIDE + 1), -1, np.int64)
    rows[row, place - before + SIDE + (place >= before)] = flat[offsets[0] : offsets[-1]][k]
    rows[:, SIDE] = pivot
    return rows, head // (SIDE + 1)


def mine(rows: np.ndarray, counts: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrases as rows of numbers, occurrences) of the phrases that fragments hold around their pivots, of ``least`` or more.

    Phrases grow from the pivot to the right, then to the left; what is too rare grows no further."""
    local = np.unique(rows, return_inverse=True)[1].reshape(rows.shape)  # numbers below 2^31, so that pairs fit into 64 bits
    none = rows < 0
    codes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {(0, 0): (np.arange(len(rows)), local[:, SIDE])}
    for left in range(SIDE + 1):
        for right in range(SIDE + 1 - left):
            if left == right == 0:
                continue
            alive, code = codes[(left - 1, right) if left else (0, right - 1)]
            column = SIDE - left if left else SIDE + right
            there = ~none[alive, column]
            alive, code = alive[there], code[there]
            key = code.astype(np.int64) << 31 | local[alive, column]
            order = np.argsort(key, kind="stable")
            new = np.ones(len(key), bool)
            new[1:] = key[order][1:] != key[order][:-1]
            group = np.cumsum(new) - 1
            total = np.bincount(group, weights=None if not len(key) else counts[alive[order]]).astype(np.int64) if len(key) else np.zeros(0, np.int64)
            good = total >= least
            starts = order[np.flatnonzero(new)][good]
            if good.any():
                yield rows[alive[starts], SIDE - left : SIDE + right + 1], total[good]
            keep = good[group] if len(key) else np.zeros(0, bool)
            codes[left, right] = alive[order[keep]], group[keep]


def _mined(least: int, kind: str):
    """Fragments by pivot and group, in order; those of several pivots are mined together."""

    def rows_of(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(held).combine_chunks()
        rows, counts = _unpacked(part.column("fragment").combine_chunks(), part.column("pivot").to_numpy(), kind)
        split = part.column("dealt").to_numpy() >= 0
        for partial in (False, True):
            some = split == partial
            if some.any():
                for phrases, n in mine(rows[some], counts[some], 1 if partial else least):
                    ids = pa.ListArray.from_arrays(np.arange(0, phrases.size + 1, phrases.shape[1], dtype=np.int32), phrases.ravel())
                    yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(np.full(len(n), partial))], ["ids", "a", "partial"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            pivot, dealt = batch.column("pivot").to_numpy(), batch.column("dealt").to_numpy()
            if n >= TOGETHER:  # up to where the group at hand ends
                end = int(np.argmax((pivot != last[0]) | (dealt != last[1]))) if ((pivot != last[0]) | (dealt != last[1])).any() else len(pivot)
                held.append(batch.slice(0, end))
                if end == len(pivot):
                    continue
                yield from rows_of(held)
                batch, held, n = batch.slice(end), [], 0
            held.append(batch)
            n += batch.num_rows
            last = int(pivot[-1]), int(dealt[-1])
        if n:
            yield from rows_of(held)

    return run


def _seed(words: DataFrame, least: int) -> int:
    """A seed under which no word of the least count has the number of another word."""
    for seed in range(64):
        shared = words.groupBy(F.xxhash64(F.lit(str(seed)), "lang", "word").bitwiseAND(F.lit(-4)).alias("h")).agg(F.count("*").alias("n"), F.max("f").alias("f"))
        if shared.filter((F.col("n") > 1) & (F.col("f") >= least)).isEmpty():
            return seed
    raise RuntimeError("no seed tells the words apart")


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, at_hand: int | None = None) -> tuple[DataFrame, DataFrame, Tables]:
    """(words, phrases, their tables): (id, lang, word, f) of the words with ``least`` occurrences and (ids, a) of the phrases.

    ``words`` also has n, the number of words of the language."""
    spark = docs.sparkSession
    at_hand = AT_HAND if at_hand is None else at_hand
    made = Tables(spark, "phrases")
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    counts = rows.mapInArrow(_counted, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("f"))
    all_words = made.write(counts)
    many = all_words.filter(F.col("f") >= least)
    known = many.orderBy(F.desc("f"), "lang", "word").limit(at_hand)
    # bounded by at_hand
    sent = known.toArrow()
    seed = _seed(all_words, least) if sent.num_rows == at_hand else None
    number = {}
    langs, words = sent.column("lang").to_pylist(), sent.column("word").cast(pa.binary()).to_pylist()
    for i, (g, w) in enumerate(zip(langs, words, strict=True)):
        number.setdefault(g, {})[w] = i
    f = sent.column("f").to_numpy()
    groups = np.append(-(-f // SPLIT), -(-f[-1] // SPLIT) if len(f) else 1)  # others are no more frequent than the last
    shared = spark.sparkContext.broadcast((number, groups, seed))
    kind = "<i4" if seed is None else "<i8"  # hashes need more than 32 bits

    def fragmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, groups, seed = shared.value
        of: dict[str, _Numbers] = {}
        parts: list[np.ndarray] = []

        def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
            rows, c = _distinct(np.concatenate(parts))
            pivot = rows[:, SIDE]
            dealt = groups[np.minimum(pivot, len(groups) - 1)]
            mixed = (rows.view(np.uint64) * (np.arange(1, 2 * SIDE + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))).sum(axis=1, dtype=np.uint64) >> np.uint64(33)
            group = np.where(dealt > 1, (mixed % dealt.astype(np.uint64)).astype(np.int64), -1)
            return pa.RecordBatch.from_arrays([pa.array(pivot), pa.array(group), _binary(rows, c, kind)], ["pivot", "dealt", "fragment"])

        for batch in slices(batches, "text"):
            for g, stretches in _by_language(batch):
                if g not in of:
                    of[g] = _Numbers(g, number.get(g, {}), seed)
                get = of[g].__getitem__
                parts += [fragments(np.fromiter(map(get, w), np.int64, len(w)), first, last) for w, first, last in stretches]
            if sum(map(len, parts)) >= TOGETHER:
                yield packed(parts)
                parts.clear()
        if sum(map(len, parts)):
            yield packed(parts)

    sent_rows = rows.mapInArrow(fragmented, "pivot long, dealt long, fragment binary")
    dealt = sent_rows.repartition("pivot", "dealt").sortWithinPartitions("pivot", "dealt")
    mined = made.write(dealt.mapInArrow(_mined(least, kind), "ids array<long>, a long, partial boolean"))
    summed = mined.filter("partial").groupBy("ids").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    phrases = made.write(mined.filter("not partial").select("ids", "a").union(summed))
    made.drop(mined)
    if seed is None:
        at = spark.createDataFrame(sent.select(["lang", "word"]).append_column("id", pa.array(np.arange(sent.num_rows)))) if sent.num_rows else many.select("lang", "word", F.lit(0).cast("long").alias("id"))
        ids = many.join(at, ["lang", "word"])
    else:
        first = spark.createDataFrame(sent.select(["lang", "word"]).append_column("at", pa.array(np.arange(sent.num_rows))))
        h = F.shiftrightunsigned(F.xxhash64(F.lit(str(seed)), "lang", "word"), 2) + AT_HAND
        ids = many.join(first, ["lang", "word"], "left").select("lang", "word", "f", F.coalesce("at", h).alias("id"))
    totals = all_words.groupBy("lang").agg(F.sum("f").alias("n"))
    words = made.write(ids.join(totals, "lang").select("id", "lang", "word", "f", "n"))
    made.drop(all_words)
    return words, phrases, made


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, most: int = MOST, at_hand: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``most`` best phrases of each language.

    a is a phrase's count, l and r those of its two parts at the cut of the lowest score floor(1000 a n / (l r)) (ties: the
    first cut), n the number of words of the language. Phrases inside a longer phrase of the same count are left out."""
    words, phrases, made = phrase_counts(docs, text, lang, least, at_hand)
    size = F.size("ids")
    whole = phrases.select("ids", "a").union(words.select(F.array("id").alias("ids"), F.col("f").alias("a")))
    cuts = phrases.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("head"), F.slice("ids", F.col("k") + 1, size - F.col("k")).alias("tail"))
    cuts = cuts.join(whole.select(F.col("ids").alias("head"), F.col("a").alias("l")), "head").join(whole.select(F.col("ids").alias("tail"), F.col("a").alias("r")), "tail")
    # what one word more makes no rarer; longer phrases of the same count hold such a one
    longer = phrases.filter(size > 2).select(F.explode(F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))).alias("ids"), "a").groupBy("ids").agg(F.max("a").alias("b"))
    left = phrases.join(longer, "ids", "left").filter("b is null or b < a").select("ids")
    # the texts of the phrases that are left
    named = left.select("ids", F.posexplode("ids").alias("at", "id")).join(words, "id")
    named = named.groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"), F.first("lang").alias("lang"), F.first("n").alias("n"))
    whole_number = "decimal(19,0)"
    score = F.expr(f"(cast(1000 * a as {whole_number}) * cast(n as {whole_number})) div (cast(l as {whole_number}) * cast(r as {whole_number}))")
    scored = cuts.join(named, "ids").withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "n", "b.l", "b.r", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within groups of each language, so that no task gets all phrases of one
    first = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(GROUPS))).orderBy(*order)
    some = best.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= most)
    last = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    return last.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = LEAST, most: int = MOST) -> str:
    """The same rows in DuckDB's SQL."""
    grams = " UNION ALL ".join(f"SELECT lang, {m} AS m, list_slice(w, i, i + {m - 1}) AS g FROM (SELECT lang, w, unnest(range(1, len(w) - {m - 2})) AS i FROM pieces WHERE len(w) >= {m})" for m in range(1, LONGEST + 1))
    return rf"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts)
), counts AS (
  SELECT lang, m, g, count(*) AS f FROM ({grams}) GROUP BY lang, m, g
), totals AS (
  SELECT lang, sum(f) AS n FROM counts WHERE m = 1 GROUP BY lang
), kept AS (
  SELECT * FROM counts WHERE f >= {least}
), inside AS (
  SELECT DISTINCT p.lang, p.g FROM kept p JOIN kept q
  ON p.lang = q.lang AND q.m = p.m + 1 AND q.f >= p.f AND (list_slice(q.g, 1, p.m) = p.g OR list_slice(q.g, 2, q.m) = p.g) WHERE p.m >= 2
), cuts AS (
  SELECT lang, m, g, f, unnest(range(1, m)) AS k FROM kept WHERE m >= 2
), scored AS (
  SELECT c.lang, c.g, c.f AS a, c.k, x.f AS l, y.f AS r, t.n,
         (1000 * CAST(c.f AS HUGEINT) * CAST(t.n AS HUGEINT)) // (CAST(x.f AS HUGEINT) * CAST(y.f AS HUGEINT)) AS score
  FROM cuts c JOIN totals t ON c.lang = t.lang
  JOIN kept x ON x.lang = c.lang AND x.m = c.k AND x.g = list_slice(c.g, 1, c.k)
  JOIN kept y ON y.lang = c.lang AND y.m = c.m - c.k AND y.g = list_slice(c.g, c.k + 1, c.m)
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), named AS (
  SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, n, score FROM best b ANTI JOIN inside i ON b.lang = i.lang AND b.g = i.g
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
       CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM named QUALIFY rank <= {most}
"""
