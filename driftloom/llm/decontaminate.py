"""Benchmark decontamination by template windows, in built-in functions only.

Both sides are canonicalised: a token with a digit becomes <num>, a unit after it <unit>, a capitalised word inside a
sentence <name>; the rest is lower-cased and loses its punctuation. Windows of eight template tokens, at least four of
them words, are joined by hash, each with all items that have it; an item of fewer tokens is one window as a whole.
Windows of a document and an item on the same
diagonal (position in the document less position in the item) form an alignment. Its slots must be consistent: one
value of the item stands for one value of the document throughout. Windows that hold another value for one that is not
do not count; windows without slots and verbatim ones do. So a question with other numbers or names is caught, and a
text that just fits the template with unrelated values is not.

A document is contaminated by an item if its alignments hold ``LEAST_SHARE`` of the item's windows or ``LEAST_WINDOWS``
of them. So of an item's n windows, m of which suffice, any n - m + 1 hold one that a contaminated document has: the
n - m + 1 that the fewest items have find the candidates, and only these meet all windows of the item. A window that
many items share therefore brings only those together with a document that little else can find.

Items of one sequence of windows whose values are equal at the same places form a class, which a document meets once,
however many items it has: an item's values are judged by where they repeat. Windows with a value that stands for several
ones count only for items that hold the document's own values there, so such items are told apart by the values that
repeat in them (a variant of the class). ``class_matches`` gives a row for each document and class (or variant, where the
class as a whole is not found), ``members`` the classes' items, ``matches`` all pairs of documents and items. So documents
and items of one template take rows in proportion to the documents, times the ways in which the items' values repeat.

Cases: null and empty texts, and items of fewer than four words, have no window and match nothing; items
whose windows and slots are all the same are one item, named by the smallest id; of an id with several texts each is an item; repeated
rows of a document count once; rows without an id cannot be named and are never contaminated; empty tables give an empty table. Only ids and texts are
read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_RE, checkpointed

WINDOW, LEAST_WORDS = 8, 4  # the window is a power of two
LEAST_SHARE, LEAST_WINDOWS = 0.5, 20
#: Windows of the benchmark up to which they are broadcast (some 100 bytes each); beyond, both sides are shuffled.
MOST_BROADCAST = 500_000

# Units that may follow a number.
UNITS = (
    "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "feet", "yd", "mi", "mile", "miles", "meter", "meters", "metre", "metres",
    "mg", "g", "kg", "t", "lb", "lbs", "oz", "ml", "cl", "dl", "l", "liter", "liters", "litre", "litres", "gal",
    "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr", "hrs", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "percent", "%", "$", "€", "£", "usd", "eur", "dollar", "dollars", "euro", "euros", "cent", "cents",
    "kb", "mb", "gb", "tb", "hz", "khz", "mhz", "ghz", "w", "kw", "v", "mph", "kmh", "km/h",
)
_PUNCTUATION = ".,;:!?\"'()[]{}«»“”…"


def _bare(text: Column) -> Column:
    """The tokens without punctuation."""
    return F.filter(F.split(F.translate(text, _PUNCTUATION, ""), SPACE_RE + "+"), lambda w: w != "")


def templates(text: Column) -> Column:
    """The template tokens, one for each bare token."""
    units = "|".join(u.replace("$", r"\$") for u in sorted(UNITS, key=lambda u: (-len(u), u)))
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{Lu}(?<=[^.!?:\s] \p{Lu})\p{Ll}\S*", "<name>")
    out = F.regexp_replace(out, r"[^\s\d]*+\d\S*+", "<num>")
    out = F.regexp_replace(out, rf"(?i)(?<=<num> )(?:{units})(?=[\s.,;:!?)]|$)", "<unit>")
    return _bare(F.lower(out))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def _pairs(step: int) -> Callable[[Column], Column]:
    """Hashes of each value and the one ``step`` after it."""

    def of(hashes: Column) -> Column:
        n = F.size(hashes) - step
        return F.when(n > 0, F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b)))

    return of


def _hashes(template: Column) -> Column:
    """The hash of each window, by way of those of two and four tokens."""
    out, step = F.transform(template, lambda t: F.xxhash64(t)), 1
    while step < WINDOW:
        out = _bound(out, _pairs(step))
        step *= 2
    return out


def _slots(template: Column, text: Column) -> Column:
    """The bare tokens with null for those that are no slot, or null if none is."""
    marked = F.zip_with(template, _bare(F.lower(text)), lambda t, w: F.when(t.startswith("<"), w))
    return _bound(marked, lambda m: F.when(F.exists(m, lambda w: w.isNotNull()), m))


def _short(template: Column, size: int, cut: Callable[[Column, Column], Column]) -> Column:
    """``cut`` of the hash and place of each window of fewer tokens."""
    places = F.sequence(F.lit(0), F.size(template) - size)
    each = F.transform(places, lambda i: cut(F.xxhash64(F.lit(size), F.slice(template, i + 1, F.lit(size))), i))
    return F.when(F.size(template) >= size, each)


def windows(rows: DataFrame, id: str, text: str, slots: bool = True, sizes: tuple[int, ...] = (WINDOW,)) -> DataFrame:
    """(id, at, h, slots): each window's place, hash, and its tokens with null for words that are no slot (null for all
    windows of a text without any slot, and without ``slots``).

    A text's windows are one array for each size, of which only the windows leave the generator."""
    out = rows.filter(F.col(id).isNotNull() & F.col(text).isNotNull())
    body = F.col(text)

    def cut(marked: Column | None, size: int) -> Callable[[Column, Column], Column]:
        def of(h: Column, i: Column) -> Column:
            mine = F.lit(None).cast("array<string>") if marked is None else F.slice(marked, i + 1, F.lit(size))
            return F.struct((i + 1).alias("at"), h.alias("h"), mine.alias("slots"))

        return of

    def cuts(t: Column, m: Column | None) -> Column:
        each = [F.transform(_hashes(t), cut(m, size)) if size == WINDOW else _short(t, size, cut(m, size)) for size in sizes]
        none = F.array().cast("array<struct<at:int,h:bigint,slots:array<string>>>")
        return each[0] if len(each) == 1 else F.concat(*[F.coalesce(e, none) for e in each])

    every = _bound(templates(body), lambda t: _bound(_slots(t, body), lambda m: cuts(t, m)) if slots else cuts(t, None))
    return out.select(F.col(id).alias("id"), F.explode(every).alias("w")).select("id", "w.at", "w.h", "w.slots")


def _values(slots: Column) -> Column:
    """The slots' values in order, null if there are none."""
    kept = F.array_compact(slots)
    return F.when(F.size(kept) > 0, kept)


def _by_text(benchmark: DataFrame, id: str, text: str) -> DataFrame:
    """(key, all): an item of the benchmark, named by id and text, and its windows in order.

    Each slot of a window has its value, the first place in the item that holds the value (its label), and whether
    another place does."""
    tokens = benchmark.filter(F.col(id).isNotNull() & F.col(text).isNotNull()).select(F.struct(F.col(id).alias("id"), F.xxhash64(text).alias("text")).alias("key"), F.col(text).alias("text"))
    tokens = tokens.distinct().withColumn("size", F.size(templates(F.col("text"))))
    mine = windows(tokens, "key", "text").withColumn("size", F.lit(WINDOW))
    for size in range(LEAST_WORDS, WINDOW):  # whole items
        mine = mine.union(windows(tokens.filter(F.col("size") == size), "key", "text", sizes=(size,)).withColumn("size", F.lit(size)))
    mine = mine.withColumnRenamed("id", "key").filter(F.col("size") - F.coalesce(F.size(_values(F.col("slots"))), F.lit(0)) >= LEAST_WORDS)
    mine = checkpointed(mine)
    slots = mine.select("key", "at", F.posexplode("slots").alias("k", "value")).filter("value is not null").withColumn("place", F.col("at") + F.col("k"))
    labels = slots.groupBy("key", "value").agg(F.min("place").alias("label"), (F.countDistinct("place") > 1).alias("repeats"))
    marks = slots.join(labels, ["key", "value"]).groupBy("key", "at").agg(F.sort_array(F.collect_list(F.struct("place", "value", "label", "repeats"))).alias("marks"))
    every = mine.join(marks, ["key", "at"], "left").groupBy("key")
    return every.agg(F.sort_array(F.collect_list(F.struct("at", "h", "size", "marks"))).alias("all"))


def _classes(by_text: DataFrame) -> DataFrame:
    """(item, family, variant, all) of items that differ; each is named by its smallest key."""
    items = by_text.groupBy("all").agg(F.min("key").alias("item"))
    pattern = F.transform("all", lambda w: F.struct(w["at"].alias("at"), w["h"].alias("h"), w["size"].alias("size"), F.transform(w["marks"], lambda m: m["label"]).alias("labels")))
    fixed = F.flatten(F.transform("all", lambda w: F.coalesce(F.filter(w["marks"], lambda m: m["repeats"]), F.array())))
    fixed = F.array_sort(F.array_distinct(F.transform(fixed, lambda m: F.struct(m["label"].alias("label"), m["value"].alias("value")))))
    items = items.withColumn("pattern", pattern).withColumn("fixed", fixed)
    families = items.groupBy("pattern").agg(F.min("item").alias("family"))
    variants = items.groupBy("pattern", "fixed").agg(F.min("item").alias("variant"))
    return items.join(families, "pattern").join(variants, ["pattern", "fixed"])


def _known_windows(items: DataFrame) -> DataFrame:
    """(h, family, item_at, labels, n, size, first): each window of each class, its slots' labels, the number of windows of
    the class, the tokens of the window, and whether it is one of those that find candidates."""
    each = items.filter("item = family").select("family", F.size("pattern").alias("n"), F.explode("pattern").alias("w"))
    each = each.select("w.h", "family", F.col("w.at").alias("item_at"), "w.labels", "n", "w.size")
    owners = each.groupBy("h").agg(F.countDistinct("family").alias("owners"))
    enough = F.least(F.ceil(LEAST_SHARE * F.col("n")), F.lit(LEAST_WINDOWS))
    rank = F.row_number().over(Window.partitionBy("family").orderBy("owners", "item_at"))
    return each.join(owners, "h").withColumn("first", rank <= F.col("n") - enough + 1).drop("owners")


def _enough(found: Column) -> Column:
    return (found >= LEAST_SHARE * F.col("n")) | (found >= LEAST_WINDOWS)


def _found(docs: DataFrame, items: DataFrame, id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What documents hold of classes.

    base (id, family, n, sure, clean, ats, values): the windows that count for all items of the class, whether no
    alignment with one of them has a value that stands for several, the windows with slots among them and their values.
    more (id, family, variant, more): the windows that count for a variant besides.
    verbatim (family, ats, values, item, variant): the items that hold these values in these windows."""
    known = checkpointed(_known_windows(items))
    sizes = tuple(sorted(r["size"] for r in known.select("size").distinct().collect())) or (WINDOW,)  # five at most
    small = known.count() <= MOST_BROADCAST
    hint = F.broadcast if small else (lambda df: df)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    probes = known.filter("first").select("h", "family")
    candidates = checkpointed(windows(rows, "id", "text", False, sizes).join(hint(probes), "h").select("id", "family").distinct())
    # only what the benchmark meets goes on; it is read twice below
    again = rows.join(candidates.select("id").distinct(), "id", "left_semi")
    hits = windows(again, "id", "text", True, sizes).join(hint(known), "h").join(candidates, ["id", "family"], "left_semi")
    pairs = F.zip_with("labels", _values(F.col("slots")), lambda a, b: F.struct(a.alias("label"), b.alias("ours")))
    hits = checkpointed(hits.select("id", "family", "n", "item_at", (F.col("at") - F.col("item_at")).alias("diagonal"), pairs.alias("pairs")))

    alignment = ["id", "family", "diagonal"]
    slots = hits.select(*alignment, F.explode("pairs").alias("p")).select(*alignment, "p.label", "p.ours")
    mixed = slots.groupBy(*alignment, "label").agg(F.min("ours").alias("low"), F.max("ours").alias("high")).filter("low <> high")
    mixed = mixed.groupBy(*alignment).agg(F.collect_set("label").alias("mixed"))
    torn = F.filter("pairs", lambda p: F.array_contains("mixed", p["label"]))
    judged = hits.join(mixed, alignment, "left").withColumn("torn", F.array_sort(F.array_distinct(torn)))
    judged = checkpointed(judged.withColumn("counts", F.coalesce(F.size("torn"), F.lit(0)) <= 0))

    seen = F.when(F.col("counts") & F.col("pairs").isNotNull(), F.struct("item_at", F.transform("pairs", lambda p: p["ours"]).alias("ours")))
    base = judged.groupBy("id", "family").agg(
        F.min("n").alias("n"),
        F.countDistinct(F.when(F.col("counts"), F.col("item_at"))).alias("sure"),
        F.min(F.when(F.col("counts"), F.col("mixed").isNull())).alias("clean"),
        F.sort_array(F.collect_set(seen)).alias("seen"),
    )
    base = base.select("id", "family", "n", "sure", F.coalesce("clean", F.lit(False)).alias("clean"), F.col("seen.item_at").alias("ats"), F.col("seen.ours").alias("values"))

    fixed = items.filter("item = variant").select("family", "variant", F.explode("fixed").alias("f")).select("family", "variant", "f.label", F.col("f.value").alias("ours"))
    asked = judged.filter(~F.col("counts")).select(*alignment, "item_at", "torn").distinct()
    each = asked.select(*alignment, "item_at", "torn", F.explode("torn").alias("t")).select(*alignment, "item_at", "torn", "t.label", "t.ours")
    held = each.join(fixed, ["family", "label", "ours"]).groupBy(*alignment, "variant", "item_at", "torn").agg(F.count(F.lit(1)).alias("held"))
    held = held.filter(F.col("held") == F.size("torn")).select("id", "family", "variant", "item_at").distinct()
    counted = judged.filter("counts").select("id", "family", "item_at", F.lit(1).alias("known")).distinct()
    more = held.join(counted, ["id", "family", "item_at"], "left").groupBy("id", "family", "variant")
    more = more.agg(F.count(F.when(F.col("known").isNull(), 1)).alias("more"))

    base = checkpointed(base)
    wanted = base.filter("clean").select("family", "ats").distinct()
    by_place = F.map_from_arrays(F.col("all.at"), F.transform("all", lambda w: F.transform(w["marks"], lambda m: m["value"])))
    verbatim = items.select("family", "item", "variant", by_place.alias("of")).join(wanted, "family")
    verbatim = verbatim.select("family", "ats", F.transform("ats", lambda a: F.element_at("of", a)).alias("values"), "item", "variant")
    return base, checkpointed(more), verbatim


def members(benchmark: DataFrame, item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, class_id, variant_id) of each item that has a window: its class and variant, named by their smallest ids."""
    by_text = checkpointed(_by_text(benchmark, item, item_text))
    out = by_text.join(_classes(by_text).select("all", "family", "variant"), "all")
    return out.select(F.col("key.id").alias(item), F.col("family.id").alias("class_id"), F.col("variant.id").alias("variant_id"))


def matches(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, n_windows, share, exact) of each contaminated document and item: all pairs, which may be many.

    ``n_windows`` are the item's windows found with consistent slots, ``share`` their share of all that it has,
    ``exact`` whether all slots agree."""
    items = checkpointed(_classes(_by_text(benchmark, item, item_text)))
    base, more, verbatim = _found(docs, items, id, text)
    out = base.join(items.select("family", "variant", "item"), "family").join(more, ["id", "family", "variant"], "left")
    out = out.withColumn("found", F.col("sure") + F.coalesce("more", F.lit(0))).filter(_enough(F.col("found")))
    out = out.join(verbatim.select("family", "ats", "values", "item", F.lit(True).alias("same")), ["family", "ats", "values", "item"], "left")
    exact = F.col("clean") & F.col("more").isNull() & F.col("same").isNotNull()
    return out.select(F.col("id").alias(id), F.col("item.id").alias(item), F.col("found").cast("long").alias("n_windows"), (F.col("found") / F.col("n")).alias("share"), exact.alias("exact"))


def class_matches(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, n_windows, share, exact, class_id, variant_id, n_items) of each contaminated document and class of items.

    ``n_items`` items of the class contaminate the document: all of it where ``variant_id`` is null, else those of this
    variant (``members`` lists both). ``item`` is the one whose slots all agree (``exact``), else the one with most
    windows found, the smallest of several; ``n_windows`` and ``share`` are as found for it."""
    items = checkpointed(_classes(_by_text(benchmark, item, item_text)))
    base, more, verbatim = _found(docs, items, id, text)
    same = verbatim.groupBy("family", "ats", "values").agg(F.min(F.struct("item", "variant")).alias("same"))
    best = more.groupBy("id", "family").agg(F.min(F.struct((-F.col("more")).alias("less"), "variant")).alias("best"))
    whole = base.filter(_enough(F.col("sure"))).join(same, ["family", "ats", "values"], "left").join(best, ["id", "family"], "left")
    whole = whole.withColumn("variant", F.col("same.variant")).join(more, ["id", "family", "variant"], "left")
    exact = F.col("clean") & F.col("more").isNull() & F.col("same").isNotNull()
    extra = F.when(exact, 0).otherwise(F.coalesce(-F.col("best.less"), F.lit(0)))
    other = F.when(F.col("best.less") < 0, F.col("best.variant")).otherwise(F.col("family"))
    none = F.lit(None).cast(items.schema["item"].dataType)
    whole = whole.select("id", F.when(exact, F.col("same.item")).otherwise(other).alias("item"), (F.col("sure") + extra).alias("found"), "n", exact.alias("exact"), "family", none.alias("variant"))
    whole = whole.join(items.groupBy("family").agg(F.count(F.lit(1)).alias("n_items")), "family")
    part = base.filter(~_enough(F.col("sure"))).join(more, ["id", "family"]).withColumn("found", F.col("sure") + F.col("more")).filter(_enough(F.col("found")))
    part = part.select("id", F.col("variant").alias("item"), "found", "n", F.lit(False).alias("exact"), "family", "variant")
    part = part.join(items.groupBy("family", "variant").agg(F.count(F.lit(1)).alias("n_items")), ["family", "variant"])
    out = whole.unionByName(part)
    return out.select(
        F.col("id").alias(id),
        F.col("item.id").alias(item),
        F.col("found").cast("long").alias("n_windows"),
        (F.col("found") / F.col("n")).alias("share"),
        "exact",
        F.col("family.id").alias("class_id"),
        F.col("variant.id").alias("variant_id"),
        "n_items",
    )


def clean(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no item contaminates."""
    found = class_matches(docs, benchmark, id, text, item, item_text).select(id).distinct()
    return docs.join(found, id, "left_anti").select(docs.columns)
