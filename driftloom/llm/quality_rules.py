"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Cases: a null text counts as empty and has no word; an empty text fails the length rule; ties cannot occur (each
row is judged alone); an empty table gives an empty result. Other columns of the input are kept, except those
that the operator sets, which it replaces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RE, others, unused

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "are", "as", "with", "by", "be", "this", "from", "or", "an", "at", "not", "have",
    "le", "la", "les", "de", "des", "du", "un", "une", "et", "en", "que", "qui", "dans", "pour", "est", "il", "elle", "sur", "au", "aux", "avec", "pas", "se", "ne",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "ist", "im", "dem", "nicht", "ein", "eine", "auf", "für", "es", "auch",
    "el", "los", "las", "y", "del", "por", "una", "con", "no", "su", "para", "al", "lo", "como",
)
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Threshold:
    """A text passes if low <= measure <= high; a missing bound does not bind."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Rules beyond the base rules. Ratios are of words unless the name says otherwise.
THRESHOLDS = (
    Threshold("chars_per_word", 2.0, 20.0),
    Threshold("symbols_per_word", None, 0.25),
    Threshold("upper_per_char", None, 0.4),
    Threshold("stop_word_share", 0.04, None),
    Threshold("dup_line_share", None, 0.3),
)


def verdict(thresholds: tuple[Threshold, ...]) -> Column:
    """The threshold table as one boolean expression."""
    out = F.lit(True)
    for t in thresholds:
        if t.low is not None:
            out &= F.col(t.measure) >= t.low
        if t.high is not None:
            out &= F.col(t.measure) <= t.high
    return out


def _repeated(words: Column, hashes: Column) -> Column:
    """Words inside windows of eight words that occur twice or more in the text.

    Windows are compared by hash; those with equal hashes are compared word by word. Sorting (hash, position)
    brings equal windows together, and a text without equal hashes, the usual case, is not sorted at all."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def same(a: Column, b: Column) -> Column:
        return (a["h"] == b["h"]) & (F.slice(words, a["i"] + 1, F.lit(WINDOW)) == F.slice(words, b["i"] + 1, F.lit(WINDOW)))

    def flagged(p: Column) -> Column:
        n = F.size(p)
        return F.filter(
            F.transform(p, lambda x, k: F.when(
                ((k > 0) & same(x, F.get(p, k - 1))) | ((k < n - 1) & same(x, F.get(p, k + 1))), x["i"])),
            lambda i: i.isNotNull(),
        )

    def covered(at: Column) -> Column:
        """The union of [i, i + 8) over sorted starts i."""
        return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).cast("int").alias("n"), i.cast("int").alias("last")))["n"]

    # a one-element array binds the sorted pairs to a name, so that they are sorted once
    starts = F.get(F.transform(F.array(pairs), flagged), 0)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(F.sort_array(starts)))


def measure(docs: DataFrame, text: str = "text", stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed and the ratios."""
    kept = [F.col(f"`{c}`") for c in others(docs, *_MADE)]
    t, w, ls, h, g = (unused(c, docs) for c in ("body", "words", "solid_lines", "hashes", "windows"))
    spaces = " \t\n\x0b\f\r"
    out = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias(t))
    out = out.select(
        *kept, t,
        F.filter(F.split(t, SPACE_RE + "+"), lambda x: x != "").alias(w),
        F.filter(F.split(t, "\n"), lambda x: F.translate(x, spaces, "") != "").alias(ls),
    )
    out = out.select(*kept, t, w, ls, F.transform(w, lambda x: F.xxhash64(x)).alias(h))
    n = F.size(h)
    # each window's hash is that of its words' hashes
    out = out.select(*kept, t, w, ls, F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, F.lit(WINDOW))))).alias(g))
    out = out.select(
        *kept,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(t, spaces, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(ls).cast("long").alias("n_lines"),
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        F.coalesce(_repeated(F.col(w), F.col(g)), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*stop_words))).cast("long").alias("n_stop_words"),
        (F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
    )
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return out.select(
        "*",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        (F.col("word_chars") / words).alias("chars_per_word"),
        (F.col("n_symbols") / words).alias("symbols_per_word"),
        (F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))).alias("upper_per_char"),
        (F.col("n_stop_words") / words).alias("stop_word_share"),
        (F.col("n_dup_lines") / lines).alias("dup_line_share"),
    )


_MADE = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_upper", "base_failed", "chars_per_word", "symbols_per_word", "upper_per_char", "stop_word_share", "dup_line_share", "kept"}


def quality_rules(docs: DataFrame, text: str = "text", thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """``measure`` and the column kept: the base rules hold and every threshold is met."""
    return measure(docs, text).withColumn("kept", ~F.col("base_failed") & verdict(thresholds))


def oracle() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    checks = " AND ".join([f"{t.measure} >= {t.low}" for t in THRESHOLDS if t.low is not None] + [f"{t.measure} <= {t.high}" for t in THRESHOLDS if t.high is not None])
    return rf"""
WITH base AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
), grams AS (
  SELECT doc_id, i, list_slice(w, i, i + 7) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM base WHERE len(w) >= 8)
), hits AS (
  SELECT doc_id, i FROM grams WINDOW d AS (PARTITION BY doc_id, g) QUALIFY count(*) OVER d >= 2
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM hits) GROUP BY doc_id
), m AS (
  SELECT b.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper
  FROM base b LEFT JOIN covered c USING (doc_id)
), r AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         word_chars / greatest(n_words, 1) AS chars_per_word, n_symbols / greatest(n_words, 1) AS symbols_per_word,
         n_upper / greatest(word_chars, 1) AS upper_per_char, n_stop / greatest(n_words, 1) AS stop_word_share,
         n_dup_lines / greatest(n_lines, 1) AS dup_line_share
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {checks} AS kept FROM r
"""
