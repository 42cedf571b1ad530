"""Matched distributions: an item's prior and actual changes of a calendar month with weights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.counter import DEFAULT_SEED, uniform
from ..functions.scalar import normal_density, or_nan
from ..sources.panel import Panel

KEYS = ("item_id", "month")
Weighing = Callable[[Column, Column], Column]


def _over() -> Window:
    return Window.partitionBy(*KEYS)


def synthetic_weights(value: Column, is_actual: Column, a: float = 0.35, eps: float = 1e-4) -> Column:
    """The density of a normal distribution at the value's distance from the mean of the actual ones; its standard
    deviation is a times that of all values."""
    mean = F.avg(F.when(is_actual, value)).over(_over())
    sd = a * F.stddev_samp(value).over(_over()) + eps
    return normal_density(F.abs(value - mean), F.lit(0.0), sd)


def _member(value: Column, flag: Column) -> Column:
    return F.max(flag.cast("int")).over(Window.partitionBy(*KEYS, value)).cast("double")


def prior_weights(value: Column, is_actual: Column) -> Column:
    """1 for values that occur among the prior ones, else 0."""
    return _member(value, ~is_actual)


def actual_weights(value: Column, is_actual: Column) -> Column:
    """1 for values that occur among the actual ones, else 0."""
    return _member(value, is_actual)


def observations(prior: Panel, actual: Panel) -> DataFrame:
    """(item_id, month, value, is_actual) of two one-base panels."""
    parts = [p.changes().select("item_id", F.month("date").alias("month"), F.col("v").alias("value"), F.lit(flag).alias("is_actual")) for p, flag in ((prior, False), (actual, True))]
    return parts[0].unionByName(parts[1])


def build(observed: DataFrame, weighing: Weighing = synthetic_weights) -> DataFrame:
    """(item_id, month, idx, value, weight, cum_lo, cum_hi, is_actual): sorted by value, weights summing to 1.

    Each item and month has prior and actual observations, else a ValueError names the first that lacks either."""
    bad = F.coalesce((F.col("month") < 1) | (F.col("month") > 12), F.lit(True))
    sides = observed.groupBy(*KEYS).agg(F.count_if(bad).alias("bad"), F.count_if(~F.col("is_actual")).alias("prior"), F.count_if("is_actual").alias("actual"))
    lacks = F.when(F.col("actual") == 0, "actual").when(F.col("prior") == 0, "prior")
    wrong, lacking = sides.agg(F.sum("bad"), F.min(F.when(lacks.isNotNull(), F.struct("item_id", "month", lacks.alias("side"))))).first()
    if wrong:
        raise ValueError("a month lies between 1 and 12")
    if lacking:
        raise ValueError(f"there are no {lacking['side']} observations of {lacking['item_id']} in month {lacking['month']}")
    out = observed.select(*KEYS, "value", "is_actual", weighing(F.col("value"), F.col("is_actual")).alias("_w"))
    order = Window.partitionBy(*KEYS).orderBy("value", "is_actual")
    out = out.select(*KEYS, F.row_number().over(order).alias("idx"), "value", (F.col("_w") / F.sum("_w").over(_over())).alias("weight"), "is_actual")
    upto = Window.partitionBy(*KEYS).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    high = F.when(F.col("idx") == F.max("idx").over(_over()), F.lit(1.0)).otherwise(F.sum("weight").over(upto))
    out = out.withColumn("cum_hi", high)
    low = F.coalesce(F.lag("cum_hi").over(Window.partitionBy(*KEYS).orderBy("idx")), F.lit(0.0))
    return out.select(*KEYS, "idx", "value", "weight", low.alias("cum_lo"), "cum_hi", "is_actual")


def stats(dist: DataFrame) -> DataFrame:
    """(item_id, month, n, mean, std): the standard deviation is corrected for the number of weights that are not 0."""
    mean = dist.groupBy(*KEYS).agg(F.count("*").alias("n"), (F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("mean"), F.count_if(F.col("weight") != 0).alias("_k"))
    d = F.col("value") - F.col("mean")
    spread = dist.join(mean, list(KEYS)).groupBy(*KEYS).agg((F.sum(F.col("weight") * d * d)).alias("_s"))
    std = or_nan(F.sqrt(F.try_divide(F.col("_k").cast("double"), (F.col("_k") - 1).cast("double")) * F.col("_s")))
    return mean.join(spread, list(KEYS)).select(*KEYS, "n", "mean", std.alias("std"))


def guide_of(cum: Column) -> Column:
    """A guide table of n + 1 entries for n ascending cumulated weights: entry j is the number of them up to j / n.

    A draw u starts at entry floor(u n) and needs not look beyond entry floor(u n) + 1, on average one weight further."""
    n = F.size(cum)
    cell = lambda i: F.when(i < 0, F.lit(0)).otherwise(F.least(F.ceil(F.get(cum, i) * n).cast("int"), n))
    steps = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_repeat(i, F.greatest(cell(i) - cell(i - 1), F.lit(0))))
    return F.concat(F.flatten(steps), F.array_repeat(n, n + 1 - cell(n - 1)))


def picked(values: Column, cum: Column, guide: Column, u: Column) -> Column:
    """The first value whose cumulated weight is above u, found through the guide table.

    One weight more on either side is looked at, as j / n and cum n are rounded."""

    def at(u: Column) -> Column:
        n = F.size(values)
        j = F.floor(u * n).cast("int")
        low, high = F.greatest(F.get(guide, j) - 1, F.lit(0)), F.least(F.get(guide, j + 1) + 1, n)
        return F.get(values, low + F.size(F.filter(F.slice(cum, low + 1, high - low), lambda c: c <= u)))

    # a one-element array binds the draw to a name, so that it is made once
    return F.get(F.transform(F.array(u), at), 0)


def _arrays(dist: DataFrame) -> DataFrame:
    """(item_id, month, values, cum, weights): one row for each distribution."""
    rows = dist.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("idx", "value", "cum_hi", "weight"))).alias("_d"))
    return rows.select(*KEYS, F.col("_d.value").alias("values"), F.col("_d.cum_hi").alias("cum"), F.col("_d.weight").alias("weights"))


def sample(dist: DataFrame, n: int, seed: int = DEFAULT_SEED, stream: str = "match") -> DataFrame:
    """(item_id, month, k, value): ``n`` draws with replacement from each distribution, each in constant time on average.

    Draws are made in the distributions' own rows; nothing is joined."""
    rows = _arrays(dist).withColumn("guide", guide_of(F.col("cum"))).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return rows.select(*KEYS, "k", picked(F.col("values"), F.col("cum"), F.col("guide"), uniform(seed, stream, "item_id", "month", "k")).alias("value"))


def sample_distinct(dist: DataFrame, n: int, ordered: bool = False, seed: int = DEFAULT_SEED, stream: str = "match") -> DataFrame:
    """(item_id, month, k, value): ``n`` draws without replacement, by the exponential race; ``ordered`` keeps idx order."""
    race = -F.log(uniform(seed, stream, "item_id", "month", "idx") + 1e-12) / F.col("weight")
    kept = dist.filter("weight > 0").withColumn("_r", race)
    kept = kept.withColumn("k", F.row_number().over(Window.partitionBy(*KEYS).orderBy("_r", "idx"))).filter(F.col("k") <= n)
    if ordered:
        kept = kept.withColumn("k", F.row_number().over(Window.partitionBy(*KEYS).orderBy("idx")))
    return kept.select(*KEYS, "k", "value")


def packed(dist: DataFrame, first_month: int) -> DataFrame:
    """One row for each item and month, with slot 1 for ``first_month``, as ``Synthetic`` takes it."""
    expected = F.aggregate(F.zip_with("values", "weights", lambda x, w: x * w), F.lit(0.0), lambda acc, x: acc + x)
    slot = F.pmod(F.col("month") - first_month, F.lit(12)) + 1
    return _arrays(dist).select("item_id", slot.cast("int").alias("slot"), "month", "values", "cum", guide_of(F.col("cum")).alias("guide"), expected.alias("expected"))


def describe(dist: DataFrame) -> DataFrame:
    """(item_id, month, label): a short text for each distribution."""
    return stats(dist).select(*KEYS, F.format_string("%s: month %d, n = %d, mean = %.4f", "item_id", "month", "n", "mean").alias("label"))
