"""Panels of monthly price changes: consecutive bases of items by months, kept as one row for each item of a base.

An item's months in a base are a short array, so that resampling, which picks among them, is a projection. ``changes``
gives the long form."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def add_months(date: dt.date, n: int) -> dt.date:
    k = date.year * 12 + date.month - 1 + n
    return dt.date(k // 12, k % 12 + 1, 1)


@dataclass(frozen=True)
class Base:
    base_id: int
    start_date: dt.date
    n_periods: int
    baseindex: float = 100.0

    @property
    def end_date(self) -> dt.date:
        return add_months(self.start_date, self.n_periods - 1)


def rechained(bases: Sequence[Base]) -> tuple[Base, ...]:
    """Bases moved so that each starts the month after the one before ends."""
    out, start = [], bases[0].start_date
    for b in bases:
        out.append(replace(b, start_date=start))
        start = add_months(start, b.n_periods)
    return tuple(out)


@dataclass(frozen=True)
class Panel:
    """``series``: base_id, item_id, w, vals (array of changes in percent, by month of the base) and any key columns.

    ``keys`` names columns that tell copies of the panel apart, such as rep and fold."""

    series: DataFrame
    bases: tuple[Base, ...]
    keys: tuple[str, ...] = ()

    @property
    def spark(self) -> SparkSession:
        return self.series.sparkSession

    @property
    def periods(self) -> int:
        return sum(b.n_periods for b in self.bases)

    @property
    def infl_periods(self) -> int:
        """Months that have a twelve-month rate."""
        return self.periods - 11

    @property
    def infl_dates(self) -> list[dt.date]:
        return self.dates[11:]

    @property
    def dates(self) -> list[dt.date]:
        return [add_months(b.start_date, i) for b in self.bases for i in range(b.n_periods)]

    def offsets(self) -> dict[int, int]:
        """Months before each base."""
        out, n = {}, 0
        for b in self.bases:
            out[b.base_id], n = n, n + b.n_periods
        return out

    def per_base(self, values: dict[int, object]):
        """A column with the value of the row's base."""
        out = None
        for k, v in values.items():
            here = F.col("base_id") == k
            v = v if hasattr(v, "isNotNull") else F.lit(v)
            out = F.when(here, v) if out is None else out.when(here, v)
        return out

    def changes(self) -> DataFrame:
        """Long form: keys, base_id, t, t_global, date, item_id, w, v."""
        starts = {b.base_id: b.start_date for b in self.bases}
        long = self.series.select(*self.keys, "base_id", "item_id", "w", F.posexplode("vals").alias("_i", "v"))
        return long.select(
            *self.keys,
            "base_id",
            (F.col("_i") + 1).alias("t"),
            (F.col("_i") + 1 + self.per_base(self.offsets())).alias("t_global"),
            F.add_months(self.per_base(starts), F.col("_i")).alias("date"),
            "item_id",
            "w",
            "v",
        )

    def items(self) -> DataFrame:
        return self.series.groupBy("base_id").agg(F.count_distinct("item_id").alias("n_items"))

    def slice(self, first: dt.date | None = None, last: dt.date | None = None) -> Panel:
        """The months from ``first`` to ``last``, both included."""
        kept, cuts = [], {}
        for b in self.bases:
            low, high = max(first or b.start_date, b.start_date), min(last or b.end_date, b.end_date)
            if low <= high:
                skip = (low.year - b.start_date.year) * 12 + low.month - b.start_date.month
                n = (high.year - low.year) * 12 + high.month - low.month + 1
                kept.append(replace(b, start_date=low, n_periods=n))
                cuts[b.base_id] = (skip, n)
        if not kept:
            raise ValueError("the panel has no month in that range")
        series = self.series.filter(F.col("base_id").isin(list(cuts)))
        first_at, size = self.per_base({k: s + 1 for k, (s, _) in cuts.items()}), self.per_base({k: n for k, (_, n) in cuts.items()})
        return replace(self, series=series.withColumn("vals", F.slice("vals", first_at, size)), bases=tuple(kept))

    def with_values(self, vals, bases: Sequence[Base] | None = None) -> Panel:
        return replace(self, series=self.series.withColumn("vals", vals), bases=tuple(bases or self.bases))


def from_changes(changes: DataFrame, weights: DataFrame, bases: Sequence[Base]) -> Panel:
    """A panel from long rows (base_id, t, item_id, v) and weights (base_id, item_id, w)."""
    series = changes.groupBy("base_id", "item_id").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("_s"))
    series = series.select("base_id", "item_id", F.col("_s.v").alias("vals")).join(weights.select("base_id", "item_id", "w"), ["base_id", "item_id"])
    return Panel(series.select("base_id", "item_id", "w", "vals"), tuple(bases))


def weighted(prices: DataFrame, bases: Sequence[Base]) -> DataFrame:
    """(base_id, item_id, w): shares of the column amount in each base."""
    by_item = prices.groupBy("base_id", "item_id").agg(F.sum("amount").alias("_a"))
    return by_item.select("base_id", "item_id", (F.col("_a") / F.sum("_a").over(Window.partitionBy("base_id"))).alias("w"))


#: Splits of the months that the sales tables cover into bases.
TWO_BASES = (Base(1, dt.date(1996, 1, 1), 36), Base(2, dt.date(1999, 1, 1), 34))
THREE_BASES = (Base(1, dt.date(1996, 1, 1), 24), Base(2, dt.date(1998, 1, 1), 24), Base(3, dt.date(2000, 1, 1), 22))


def sales_panel(spark: SparkSession, sf_dir: str, bases: Sequence[Base] = TWO_BASES) -> Panel:
    """Price changes of brands by month from lineitem and part: the unit value of a month against the month before.

    Months without a sale keep the price before. Months run from January 1995 to October 2001."""
    first, last = dt.date(1995, 1, 1), dt.date(2001, 10, 1)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    lines = lines.filter((F.col("l_shipdate") >= F.lit(str(first))) & (F.col("l_shipdate") < F.lit(str(add_months(last, 1)))))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("item_id"))
    monthly = lines.join(parts, "l_partkey").groupBy("item_id", F.trunc("l_shipdate", "month").alias("date"))
    monthly = monthly.agg(F.sum("l_extendedprice").alias("amount"), F.sum("l_quantity").alias("quantity"))
    # an item's months are a row from here on: a dense array, filled and differenced within the row
    n = (last.year - first.year) * 12 + last.month - first.month + 1
    at = ((F.year("date") - first.year) * 12 + F.month("date") - first.month).cast("int")
    rows = monthly.select("item_id", at.alias("m"), "amount", (F.col("amount") / F.col("quantity")).alias("price"))
    packed = rows.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("m", "price"))).alias("prices"), F.map_from_entries(F.collect_list(F.struct("m", "amount"))).alias("amounts"))
    filled = F.aggregate(
        F.sequence(F.lit(0), F.lit(n - 1)),
        F.array().cast("array<double>"),
        lambda acc, m: F.array_append(acc, F.coalesce(F.try_element_at("prices", m), F.try_element_at(acc, F.lit(-1)))),
    )
    packed = packed.select("item_id", "amounts", filled.alias("price"))
    out = None
    for b in bases:
        skip = (b.start_date.year - first.year) * 12 + b.start_date.month - first.month
        vals = F.transform(F.sequence(F.lit(skip), F.lit(skip + b.n_periods - 1)), lambda m: 100.0 * (F.get("price", m) / F.get("price", m - 1) - 1))
        amount = F.aggregate(F.sequence(F.lit(skip), F.lit(skip + b.n_periods - 1)), F.lit(0.0), lambda acc, m: acc + F.coalesce(F.try_element_at("amounts", m), F.lit(0.0)))
        part = packed.select(F.lit(b.base_id).alias("base_id"), "item_id", amount.alias("_a"), vals.alias("vals"))
        out = part if out is None else out.unionByName(part)
    out = out.withColumn("w", F.col("_a") / F.sum("_a").over(Window.partitionBy("base_id")))
    return Panel(out.select("base_id", "item_id", "w", "vals"), tuple(bases))
