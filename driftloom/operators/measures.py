"""Inflation measures: functions from a panel to twelve-month rates by month (keys..., t_global, date, infl).

The formulas are this project's own definitions. A panel's months of one key are short series, so each measure is one
aggregation over items followed by windows over months, all by the same keys."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.panel import Panel
from .selection import percentiles


def _by(keys: Sequence[str], *more: str) -> list[str]:
    return [*keys, *more]


def yearly(monthly: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chain the monthly changes ``m`` (percent) to twelve-month rates, from the twelfth month on."""
    order = Window.partitionBy(*keys).orderBy("t_global") if keys else Window.partitionBy(F.lit(0)).orderBy("t_global")
    chained = F.product(1 + F.col("m") / 100).over(order.rowsBetween(-11, 0))
    out = monthly.select(*keys, "t_global", "date", (100 * (chained - 1)).alias("infl"), F.row_number().over(order).alias("_n"))
    return out.filter(F.col("_n") >= 12).drop("_n")


class Measure(ABC):
    """A measure that ``joint`` says so takes part in ``together``: from ``item_values`` (arrays of an item's months, made in
    its row) and ``month_values`` (aggregates over a month's items) ``change`` gives the month's change."""

    name: str
    tag: str
    joint = False

    def item_values(self, n: Column) -> Column | None:
        """An array by month of a series of n months with the column vals."""
        return None

    def month_values(self, own: Column | None) -> Column:
        """An aggregate over rows w, v and ``own``, the measure's item value."""
        raise NotImplementedError

    def change(self, value: Column, order: Window) -> Column:
        """The month's change from the aggregate; ``order`` is a replicate's months."""
        return value

    @property
    def params(self) -> tuple:
        return ()

    @property
    def measures(self) -> tuple[Measure, ...]:
        return (self,)

    @property
    def num_measures(self) -> int:
        return len(self.measures)

    @abstractmethod
    def monthly(self, panel: Panel) -> DataFrame:
        """(keys..., t_global, date, m)."""

    def apply(self, panel: Panel) -> DataFrame:
        return yearly(self.monthly(panel), panel.keys)

    def __repr__(self) -> str:
        return f"{self.name} ({self.tag})"


def _chained(long: DataFrame, keys: Sequence[str], segment: Column) -> DataFrame:
    """Monthly changes of the weighted mean of item indices that start at 100 in each segment of a base."""
    long = long.withColumn("_seg", segment)
    within = Window.partitionBy(*keys, "base_id", "item_id", "_seg").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    index = long.withColumn("_i", 100.0 * F.product(1 + F.col("v") / 100).over(within))
    total = index.groupBy(*keys, "base_id", "_seg", "t", "t_global", "date").agg((F.sum(F.col("w") * F.col("_i")) / F.sum("w")).alias("_x"))
    before = F.coalesce(F.lag("_x").over(Window.partitionBy(*keys, "base_id", "_seg").orderBy("t")), F.lit(100.0))
    return total.select(*keys, "t_global", "date", (100 * (F.col("_x") / before - 1)).alias("m"))


def _item_index(n: Column, starts: Callable[[Column], Column]) -> Column:
    """An item's index by month, 100 before the months that ``starts`` names (counted from 0)."""

    def step(acc: Column, i: Column) -> Column:
        before = F.when((i == 0) | starts(i), F.lit(100.0)).otherwise(F.element_at(acc, F.lit(-1)))
        return F.array_append(acc, before * (1 + F.get("vals", i) / 100))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), F.array().cast("array<double>"), step)).otherwise(F.array().cast("array<double>"))


def _index_change(value: Column, order: Window, starts: Callable[[Column], Column]) -> Column:
    i = F.col("t") - 1
    before = F.when((i == 0) | starts(i), F.lit(100.0)).otherwise(F.lag(value).over(order))
    return 100 * (value / before - 1)


def _weighted_mean(v: Column) -> Column:
    return F.sum(F.col("w") * v) / F.sum("w")


@dataclass(frozen=True, repr=False)
class TotalIndex(Measure):
    """The change of the weighted mean of item indices, chained over bases."""

    name = "Total index"
    tag = "Total"
    joint = True

    def item_values(self, n: Column) -> Column:
        return _item_index(n, lambda i: F.lit(False))

    def month_values(self, own: Column | None) -> Column:
        return _weighted_mean(own)

    def change(self, value: Column, order: Window) -> Column:
        return _index_change(value, order, lambda i: F.lit(False))

    def monthly(self, panel: Panel) -> DataFrame:
        return _chained(panel.changes(), panel.keys, F.lit(0))


@dataclass(frozen=True, repr=False)
class RebasedIndex(Measure):
    """``TotalIndex`` with item indices set to 100 again every ``period`` months, ``maxchanges`` times at most."""

    period: int = 60
    maxchanges: int | None = None
    name = "Total index with synthetic base changes"
    joint = True

    def _starts(self, i: Column) -> Column:
        begins = F.pmod(i, F.lit(self.period)) == 0
        return begins if self.maxchanges is None else begins & (i <= self.period * self.maxchanges)

    def item_values(self, n: Column) -> Column:
        return _item_index(n, self._starts)

    def month_values(self, own: Column | None) -> Column:
        return _weighted_mean(own)

    def change(self, value: Column, order: Window) -> Column:
        return _index_change(value, order, self._starts)

    @property
    def tag(self) -> str:
        return f"TotalRebase({self.period},{self.maxchanges})" if self.maxchanges is not None else f"TotalRebase({self.period})"

    @property
    def params(self) -> tuple:
        return (self.period, self.maxchanges)

    def monthly(self, panel: Panel) -> DataFrame:
        segment = F.floor((F.col("t") - 1) / self.period).cast("int")
        if self.maxchanges is not None:
            segment = F.least(segment, F.lit(self.maxchanges))
        return _chained(panel.changes(), panel.keys, segment)


@dataclass(frozen=True, repr=False)
class WeightedMean(Measure):
    name = "Weighted mean"
    tag = "WeightedMean"
    joint = True

    def month_values(self, own: Column | None) -> Column:
        return _weighted_mean(F.col("v"))

    def monthly(self, panel: Panel) -> DataFrame:
        return panel.changes().groupBy(*panel.keys, "t_global", "date").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m"))


def _spread(panel: Panel, q: float, weight: str | None) -> DataFrame:
    keys = _by(panel.keys, "t_global", "date")
    return percentiles(panel.changes(), keys, "v", [q], weight).select(*keys, F.get("percentiles", F.lit(0)).alias("m"))


@dataclass(frozen=True, repr=False)
class PercentileEq(Measure):
    """The q-th percentile of the items' changes, 0 to 100; ``spread`` finds it by counts (``selection``), for months of
    very many items."""

    q: float
    spread: bool = False
    name = "Percentile"

    @property
    def joint(self) -> bool:
        return not self.spread

    def month_values(self, own: Column | None) -> Column:
        return F.percentile("v", self.q / 100)

    @property
    def tag(self) -> str:
        return f"PercEq-{self.q:g}"

    @property
    def params(self) -> tuple:
        return (self.q,)

    def monthly(self, panel: Panel) -> DataFrame:
        if self.spread:
            return _spread(panel, self.q, None)
        return panel.changes().groupBy(*panel.keys, "t_global", "date").agg(F.percentile("v", self.q / 100).alias("m"))


@dataclass(frozen=True, repr=False)
class PercentileWeighted(Measure):
    """The first change, in order, at which the weights so far reach q percent of all; ``spread`` as in ``PercentileEq``."""

    q: float
    spread: bool = False
    name = "Weighted percentile"

    @property
    def joint(self) -> bool:
        return not self.spread

    def month_values(self, own: Column | None) -> Column:
        return _weighted_percentiles([self.q])[0]

    @property
    def tag(self) -> str:
        return f"PercW-{self.q:g}"

    @property
    def params(self) -> tuple:
        return (self.q,)

    def monthly(self, panel: Panel) -> DataFrame:
        if self.spread:
            return _spread(panel, self.q, "w")
        keys = _by(panel.keys, "t_global", "date")
        order = Window.partitionBy(*keys).orderBy("v", "item_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = panel.changes().select(*keys, "v", F.sum("w").over(order).alias("_c"), F.sum("w").over(Window.partitionBy(*keys)).alias("_t"))
        # the total is reached despite rounding
        return rows.filter(F.col("_c") >= self.q / 100 * F.col("_t") - 1e-12).groupBy(*keys).agg(F.min("v").alias("m"))


@dataclass(frozen=True, repr=False)
class Ensemble(Measure):
    """Several measures of one panel, told apart by measure_id."""

    parts: Sequence[Measure]
    name = "Ensemble"

    @property
    def tag(self) -> str:
        return "+".join(m.tag for m in self.parts)

    @property
    def measures(self) -> tuple[Measure, ...]:
        return tuple(x for m in self.parts for x in m.measures)

    def monthly(self, panel: Panel) -> DataFrame:
        raise ValueError("an ensemble has no single monthly series")

    def apply(self, panel: Panel) -> DataFrame:
        """All measures from one pass over the panel, so that they see its replicates without drawing them again."""
        parts = self.measures
        if all(m.joint for m in parts) and len({m.tag for m in parts}) == len(parts):
            return together(panel, {m.tag: m for m in parts})
        out = None
        for m in parts:
            one = m.apply(panel).withColumn("measure_id", F.lit(m.tag))
            out = one if out is None else out.unionByName(one)
        return out


def _weighted_percentiles(qs: Sequence[float]) -> Column:
    """The weighted percentiles of a month as an array: its items sorted once, then one walk along them for each."""
    items = F.array_sort(F.collect_list(F.struct("v", "item_id", "w")))

    def first(sorted_: Column, total: Column, q: float) -> Column:
        start = F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("m"))
        step = lambda acc, x: F.struct((acc["c"] + x["w"]).alias("c"), F.coalesce(acc["m"], F.when(acc["c"] + x["w"] >= q / 100 * total - 1e-12, x["v"])).alias("m"))
        return F.aggregate(sorted_, start, step)["m"]

    total = lambda s: F.aggregate(s, F.lit(0.0), lambda acc, x: acc + x["w"])
    # one-element arrays bind the sorted items and their total to names
    return F.get(F.transform(F.array(items), lambda s: F.get(F.transform(F.array(total(s)), lambda t: F.array(*[first(s, t, q) for q in qs])), 0)), 0)


def together(panel: Panel, measures: dict[str, Measure]) -> DataFrame:
    """(keys..., t_global, date, measure_id, infl) of several joint measures by one aggregation and one set of windows.

    Item indices are made in the items' rows; all percentiles come from one buffer a month, all weighted ones from one
    sorted list a month."""
    names = list(measures)
    rows = {f"_x{i}": own for i, k in enumerate(names) if (own := measures[k].item_values(F.size("vals"))) is not None}
    series = panel.series.select(*panel.keys, "base_id", "item_id", "w", "vals", *[c.alias(k) for k, c in rows.items()])
    long = series.select(*panel.keys, "base_id", "item_id", "w", F.posexplode(F.arrays_zip("vals", *rows)).alias("_i", "_z"))
    starts = {b.base_id: b.start_date for b in panel.bases}
    place = [(F.col("_i") + 1).alias("t"), (F.col("_i") + 1 + panel.per_base(panel.offsets())).alias("t_global"), F.add_months(panel.per_base(starts), F.col("_i")).alias("date")]
    long = long.select(*panel.keys, "base_id", *place, "item_id", "w", F.col("_z.vals").alias("v"), *[F.col(f"_z.{k}").alias(k) for k in rows])
    equal = [i for i, k in enumerate(names) if isinstance(measures[k], PercentileEq)]
    weighted = [i for i, k in enumerate(names) if isinstance(measures[k], PercentileWeighted)]
    found = [measures[k].month_values(F.col(f"_x{i}") if f"_x{i}" in rows else None).alias(f"_v{i}") for i, k in enumerate(names) if i not in equal and i not in weighted]
    if equal:
        found.append(F.percentile("v", F.array(*[F.lit(measures[names[i]].q / 100) for i in equal])).alias("_eq"))
    if weighted:
        found.append(_weighted_percentiles([measures[names[i]].q for i in weighted]).alias("_wt"))
    months = long.groupBy(*panel.keys, "base_id", "t", "t_global", "date").agg(*found)
    several = [F.col("_eq")[j].alias(f"_v{i}") for j, i in enumerate(equal)] + [F.col("_wt")[j].alias(f"_v{i}") for j, i in enumerate(weighted)]
    single = [c for c in months.columns if c.startswith("_v")]
    months = months.select(*panel.keys, "t", "t_global", "date", *single, *several)
    order = Window.partitionBy(*panel.keys).orderBy("t_global") if panel.keys else Window.partitionBy(F.lit(0)).orderBy("t_global")
    changes = months.select(*panel.keys, "t_global", "date", *[measures[k].change(F.col(f"_v{i}"), order).alias(f"_m{i}") for i, k in enumerate(names)], F.row_number().over(order).alias("_n"))
    year = order.rowsBetween(-11, 0)
    rates = changes.select(*panel.keys, "t_global", "date", "_n", *[(100 * (F.product(1 + F.col(f"_m{i}") / 100).over(year) - 1)).alias(k) for i, k in enumerate(names)])
    ids = [*panel.keys, "t_global", "date"]
    kept = rates.filter("_n >= 12").select(*ids, *[f"`{k}`" for k in names])
    return kept.unpivot([F.col(c) for c in ids], [F.col(f"`{k}`") for k in names], "measure_id", "infl").select(*ids, "infl", "measure_id")
