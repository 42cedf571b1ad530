"""Exact percentiles of very large groups by counts, without sorting a group or holding it in one buffer.

Three passes, each with partial aggregates on the map side, whatever the group's size:

1. a mergeable sketch gives ``BUCKETS`` - 1 cuts of each group, so that its buckets hold about as many rows each, however
   skewed the values,
2. rows and weights of each bucket are summed; in the group's row of bucket sums each percentile finds its bucket,
3. of those buckets alone the different values are counted (and their weights summed), and picked by running sums.

Results do not depend on the sketch: buckets are intervals of values and their sums are exact, only their sizes vary. What
meets in one row is the buckets' sums, or the different values of one bucket, which are passed once for each percentile. Plain and weighted percentiles
of the same values take the same passes. The cuts of all groups are broadcast up to ``MOST_GROUPS`` groups (some 600 bytes each) and
joined by hash beyond.

Cases: null values are left out (a group of nulls gives null); equal values are one value; an empty table gives no group;
null keys are groups of their own; a group of one value gives that value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A power of two.
BUCKETS = 64
ACCURACY = 2000
MOST_GROUPS = 100_000


def _joined(rows: DataFrame, groups: DataFrame, keys: Sequence[str], small: bool, how: str = "inner") -> DataFrame:
    """Rows with what their group has; null keys are equal."""
    other = groups.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in groups.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = rows.join(F.broadcast(other) if small else other.hint("shuffle_hash"), same, how)
    return joined.drop(*[f"_k{i}" for i in range(len(keys))])


def _running(sums: Column, field: str, zero: Column) -> Column:
    """Sums of ``field`` up to each of the sorted structs, as arrays of the same length."""
    step = lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), zero) + x[field])
    return F.aggregate(sums, F.slice(F.array(zero), 1, 0), step)


def _first(totals: Column, reached: Column) -> Column:
    """The place, from 0, of the first total for which ``reached`` (a function) holds; the last place if there is none."""
    return F.least(F.size(F.filter(totals, lambda x: ~reached(x))), F.size(totals) - 1)


def _in_buckets(rows: DataFrame) -> DataFrame:
    """Rows with ``_b``, the number of ``_cuts`` below ``_v`` (null if that is null): the bucket (cut before, own cut]; equal
    cuts make empty buckets."""
    rows = rows.withColumn("_b", F.when(F.col("_v").isNotNull(), 0))
    step = BUCKETS // 2
    while step:  # by halves, each a column of its own
        rows = rows.withColumn("_b", F.col("_b") + F.when(F.get("_cuts", F.col("_b") + (step - 1)) < F.col("_v"), step).otherwise(0))
        step //= 2
    return rows


def _pick(values: Column, field: str, goal: Column) -> Column:
    """Of sorted structs the first value at which the sum of ``field`` so far reaches the goal (is beyond it, for counts), else
    the last; one pass without a copy of the sums."""

    def step(acc: Column, e: Column) -> Column:
        so_far = acc["s"] + e[field]
        there = so_far > goal if field == "_n" else so_far >= goal
        return F.struct(so_far.alias("s"), F.coalesce(acc["v"], F.when(there, e["_v"])).alias("v"))

    zero = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("v"))
    return F.coalesce(F.aggregate(values, zero, step)["v"], F.get(values, F.size(values) - 1)["_v"])


def percentiles(rows: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], weight: str | None = None) -> DataFrame:
    """(keys, percentiles): for each group the values at ``qs`` percent, as an array of doubles.

    Without weights they are interpolated between the two nearest values; with weights they are the first value, in
    order, at which the weights so far reach q percent of all."""
    return percentiles_of(rows, keys, value, qs, {"percentiles": weight})


def percentiles_of(rows: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], kinds: Mapping[str, str | None]) -> DataFrame:
    """(keys, an array for each of ``kinds``): the ``percentiles`` by each kind's weights (None: plain), from the same passes."""
    weights = [w for w in kinds.values() if w]
    v = rows.select(*keys, F.col(value).cast("double").alias("_v"), *[F.col(w).cast("double").alias(f"_w{i}") for i, w in enumerate(weights)])
    share = [(i + 1) / BUCKETS for i in range(BUCKETS - 1)]
    cuts = v.groupBy(*keys).agg(F.percentile_approx("_v", share, ACCURACY).alias("_cuts"))
    small = cuts.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS
    sums_of = [F.sum(f"_w{i}").alias(f"_w{i}") for i in range(len(weights))]
    placed = _in_buckets(_joined(v, cuts, keys, small)).drop("_cuts")
    sums = placed.groupBy(*keys, "_b").agg(F.count("*").alias("_n"), *sums_of)
    row = F.when(F.col("_b").isNotNull(), F.struct("_b", "_n", *[f"_w{i}" for i in range(len(weights))]))
    by_group = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_s"))
    fields = ["_n", *[f"_w{i}" for i in range(len(weights))]]
    by_group = by_group.select("*", *[_running(F.col("_s"), f, F.lit(0).cast("long" if f == "_n" else "double")).alias(f"_run{f}") for f in fields])
    n = F.try_element_at("_run_n", F.lit(-1))
    wanted, weighted = [], iter(range(len(weights)))
    for w in kinds.values():
        field = f"_w{next(weighted)}" if w else "_n"
        for q in qs:
            if w:
                goal = F.lit(q / 100) * F.try_element_at(f"_run{field}", F.lit(-1)) - 1e-12
                wanted.append((field, goal, _first(F.col(f"_run{field}"), lambda x, g=goal: x >= g)))
            else:
                rank = F.lit(q / 100) * (n - 1)
                wanted += [(field, g.cast("double"), _first(F.col("_run_n"), lambda x, g=g: x > g)) for g in (F.floor(rank), F.ceil(rank))]
    found = [F.struct(F.get("_s", at)["_b"].alias("b"), (goal - F.when(at > 0, F.get(f"_run{f}", at - 1)).otherwise(F.lit(0))).cast("double").alias("goal")) for f, goal, at in wanted]
    targets = by_group.select(*keys, F.array(*found).alias("_t"), n.alias("_total"))
    buckets = targets.select(*keys, F.explode(F.array_distinct(F.transform("_t", lambda t: t["b"]))).alias("_b")).filter("_b is not null")
    each = _joined(placed, buckets, [*keys, "_b"], small).groupBy(*keys, "_b", "_v").agg(F.count("*").cast("double").alias("_n"), *sums_of)
    values = each.groupBy(*keys, "_b").agg(F.array_sort(F.collect_list(F.struct("_v", *fields))).alias("_e"))
    picks = []
    for i, (f, _, _) in enumerate(wanted):
        t = F.get("_t", F.lit(i))
        picks.append(F.max(F.when(t["b"] == F.col("_b"), _pick(F.col("_e"), f, t["goal"]))).alias(f"_p{i}"))
    picked = _joined(values, targets.select(*keys, "_t"), keys, small).groupBy(*keys).agg(*picks)
    # groups without any value have no picks
    done, at, out = _joined(targets.select(*keys, "_total"), picked, keys, small, "left"), 0, []
    for name, w in kinds.items():
        values = []
        for q in qs:
            if w:
                values.append(F.col(f"_p{at}"))
            else:
                rank = F.lit(q / 100) * (F.col("_total") - 1)
                low, high, part = F.col(f"_p{at}"), F.col(f"_p{at + 1}"), rank - F.floor(rank)
                values.append(low + (high - low) * part)
            at += 1 if w else 2
        out.append(F.array(*values).alias(name))
    return done.select(*keys, *out)
