"""Resampling of panels by calendar month, and the population counterpart of each resampler.

A resampler turns an item's months into other months of the same item and base by a column expression, so all
replicates come from one projection. Replicates are dealt by hash of ``rep`` before they grow; what groups or orders
within a replicate afterwards needs no further shuffle."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.counter import DEFAULT_SEED, uniform
from ..sources.panel import Base, Panel, rechained
from .matching import picked

YEAR = 12
#: Series (items of bases) up to which a panel is broadcast to its replicates (some 1 KB each); larger ones are
#: repeated where they are and dealt afterwards.
MOST_BROADCAST = 200_000


def replicate(panel: Panel, reps: int, key: str = "rep") -> Panel:
    """``reps`` copies of the panel, numbered from 1 in ``key`` and dealt by it."""
    spark = panel.spark
    n = min(reps, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    if panel.series.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        ids = spark.range(1, reps + 1).select(F.col("id").cast("int").alias(key)).repartition(n, key)
        series = ids.crossJoin(F.broadcast(panel.series))
    else:
        series = panel.series.withColumn(key, F.explode(F.sequence(F.lit(1), F.lit(reps)))).repartition(n, key)
    return replace(panel, series=series, keys=(*panel.keys, key))


def _months(n: int, f) -> Column:
    """f of each month 1..n as an array."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), f)


def _stripe(t: Column) -> Column:
    return F.pmod(t - 1, F.lit(YEAR))


def _stripe_size(n: int, t: Column) -> Column:
    """Months of a base of n months with the calendar month of its month t."""
    return F.floor((F.lit(n) - 1 - _stripe(t)) / YEAR).cast("int") + 1


def _stripe_sums(n: int) -> Column:
    """For each calendar month in turn the sum over the item's months."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(min(n, YEAR) - 1)),
        lambda m: F.aggregate(F.sequence(m, F.lit(n - 1), F.lit(YEAR)), F.lit(0.0), lambda acc, i: acc + F.get("vals", i)),
    )


class Resampler(ABC):
    """``sample`` draws replicates, ``population`` gives the expected changes."""

    name: str
    tag: str

    @abstractmethod
    def draw(self, base: Base, at: int, seed: int | Column) -> Column:
        """The drawn months of a series; ``at`` is the base's place, columns rep, base_id and item_id are there."""

    @abstractmethod
    def mean(self, base: Base, at: int) -> Column:
        """The expected months of a series."""

    def length(self, base: Base, at: int, n_bases: int) -> int:
        return base.n_periods

    def prepare(self, panel: Panel) -> Panel:
        """Add columns that ``draw`` and ``mean`` need."""
        return panel

    def validate(self, panel: Panel) -> None:
        """Raise ValueError where the panel does not fit."""

    def _bases(self, panel: Panel) -> tuple[Base, ...]:
        n = len(panel.bases)
        return rechained([replace(b, n_periods=self.length(b, i, n)) for i, b in enumerate(panel.bases)])

    def _with(self, panel: Panel, bases: Sequence[Base], expressions: dict[int, Column]) -> Panel:
        out = panel.with_values(panel.per_base(expressions), bases)
        return replace(out, series=out.series.select(*out.keys, "base_id", "item_id", "w", "vals"))

    def sample(self, panel: Panel, reps: int, seed: int | Column = DEFAULT_SEED) -> Panel:
        self.validate(panel)
        copies = replicate(self.prepare(panel), reps)
        return self._with(copies, self._bases(panel), {b.base_id: self.draw(b, i, seed) for i, b in enumerate(panel.bases)})

    def population(self, panel: Panel) -> Panel:
        self.validate(panel)
        return self._with(self.prepare(panel), self._bases(panel), {b.base_id: self.mean(b, i) for i, b in enumerate(panel.bases)})

    def __repr__(self) -> str:
        return f"{self.name} ({self.tag})"


@dataclass(frozen=True, repr=False)
class ScrambleByMonth(Resampler):
    """Each month is drawn from the same item's months of its calendar month, all alike likely."""

    name = "Resampling by calendar month"
    tag = "SVM"
    stream = "svm"

    def draw(self, base: Base, at: int, seed: int | Column) -> Column:
        n = base.n_periods

        def one(t: Column) -> Column:
            u = uniform(seed, self.stream, "rep", "base_id", t, "item_id")
            return F.get("vals", _stripe(t) + YEAR * F.floor(u * _stripe_size(n, t)).cast("int"))

        return _months(self.length(base, at, 0), one)

    def mean(self, base: Base, at: int) -> Column:
        n = base.n_periods
        # a one-element array binds the sums to a name
        return F.get(F.transform(F.array(_stripe_sums(n)), lambda s: _months(self.length(base, at, 0), lambda t: F.get(s, _stripe(t)) / _stripe_size(n, t))), 0)


@dataclass(frozen=True, repr=False)
class ExtendedScramble(ScrambleByMonth):
    """``ScrambleByMonth`` with other lengths: one for all bases, or one for each."""

    periods: int | Sequence[int] = 0
    name = "Extended resampling by calendar month"
    tag = "ESVM"
    stream = "esvm"

    def _all(self) -> list[int]:
        return [self.periods] if isinstance(self.periods, int) else list(self.periods)

    def length(self, base: Base, at: int, n_bases: int) -> int:
        every = self._all()
        return every[0] if len(every) == 1 else every[at]

    def validate(self, panel: Panel) -> None:
        every = self._all()
        if len(every) not in (1, len(panel.bases)):
            raise ValueError(f"{len(every)} lengths for {len(panel.bases)} bases")
        for i, b in enumerate(panel.bases):
            if b.n_periods < YEAR and self.length(b, i, 0) > b.n_periods:
                raise ValueError(f"base {b.base_id} has no observation for some calendar months")


@dataclass(frozen=True, repr=False)
class WeightedScramble(Resampler):
    """A month keeps its value with probability p and else takes one of its stripe's others, all alike likely."""

    p: float
    name = "Weighted resampling by calendar month"
    tag = "RST"
    stream = "rst"

    def __post_init__(self) -> None:
        for p in [self.p] if isinstance(self.p, (int, float)) else self.p:
            if not 0 <= p <= 1:
                raise ValueError("a probability lies between 0 and 1")

    def chance(self, at: int) -> float:
        return float(self.p)

    def draw(self, base: Base, at: int, seed: int | Column) -> Column:
        n, p = base.n_periods, self.chance(at)

        def one(t: Column) -> Column:
            u = uniform(seed, self.stream, "rep", "base_id", t, "item_id")
            size, own = _stripe_size(n, t), F.floor((t - 1) / YEAR).cast("int")
            other = F.floor((u - p) / (1 - p) * (size - 1)).cast("int") if p < 1 else own
            other = other + (other >= own).cast("int")
            return F.get("vals", _stripe(t) + YEAR * F.when((size == 1) | (u < p), own).otherwise(other))

        return _months(n, one)

    def mean(self, base: Base, at: int) -> Column:
        n, p = base.n_periods, self.chance(at)

        def one(s: Column, t: Column) -> Column:
            v, size = F.get("vals", t - 1), _stripe_size(n, t)
            return F.when(size == 1, v).otherwise(p * v + (1 - p) / F.greatest(size - 1, F.lit(1)) * (F.get(s, _stripe(t)) - v))

        return F.get(F.transform(F.array(_stripe_sums(n)), lambda s: _months(n, lambda t: one(s, t))), 0)


@dataclass(frozen=True, repr=False)
class WeightedScrambleByBase(WeightedScramble):
    """``WeightedScramble`` with a probability for each base; p is a sequence."""

    p: Sequence[float]
    name = "Weighted resampling by calendar month and base"
    tag = "RSTI"
    stream = "rsti"

    def chance(self, at: int) -> float:
        return float(self.p[at])

    def validate(self, panel: Panel) -> None:
        if len(self.p) != len(panel.bases):
            raise ValueError(f"{len(self.p)} probabilities for {len(panel.bases)} bases")


@dataclass(frozen=True, repr=False)
class Identity(Resampler):
    """Every replicate is the panel itself."""

    name = "No resampling"
    tag = "IDTY"

    def draw(self, base: Base, at: int, seed: int | Column) -> Column:
        return F.col("vals")

    def mean(self, base: Base, at: int) -> Column:
        return F.col("vals")


@dataclass(frozen=True, repr=False)
class Mixture(Resampler):
    """The i-th resampler for the i-th base; a lone base takes the first."""

    parts: Sequence[Resampler] = field(default_factory=list)
    name = "Mixture of resamplers"
    tag = "MIX"

    def _part(self, at: int, n_bases: int) -> Resampler:
        return self.parts[at]

    def validate(self, panel: Panel) -> None:
        if len(panel.bases) > 1 and len(self.parts) != len(panel.bases):
            raise ValueError(f"{len(self.parts)} resamplers for {len(panel.bases)} bases")
        for i, b in enumerate(panel.bases):
            part = self.parts[i]
            if isinstance(part, WeightedScrambleByBase):
                continue
            part.validate(replace(panel, bases=(b,)) if not isinstance(part, ExtendedScramble) or len(part._all()) == 1 else panel)

    def prepare(self, panel: Panel) -> Panel:
        for part in self.parts:
            panel = part.prepare(panel)
        return panel

    def length(self, base: Base, at: int, n_bases: int) -> int:
        return self.parts[at].length(base, at, n_bases)

    def draw(self, base: Base, at: int, seed: int | Column) -> Column:
        return self.parts[at].draw(base, at, seed)

    def mean(self, base: Base, at: int) -> Column:
        return self.parts[at].mean(base, at)


@dataclass(frozen=True, repr=False)
class Synthetic(Resampler):
    """A lone base's months drawn from matched distributions, one for each item and calendar month in turn.

    ``matching`` has item_id, slot (1 for the first month), month, values, cum, guide and expected, as
    ``matching.packed`` makes it; a draw takes constant time on average."""

    matching: DataFrame
    periods: int | None = None
    name = "Resampling from matched distributions"
    tag = "SYNTH"
    stream = "synth"

    def length(self, base: Base, at: int, n_bases: int) -> int:
        return self.periods if self.periods is not None else base.n_periods

    def validate(self, panel: Panel) -> None:
        if len(panel.bases) != 1:
            raise ValueError("matched distributions serve one base, not a chain of bases")
        if self.periods is not None and self.periods < 1:
            raise ValueError("the number of periods is positive")
        base = panel.bases[0]
        slots = self.matching.groupBy("slot").agg(F.count_distinct("month").alias("months"), F.min("month").alias("month"), F.count_distinct("item_id").alias("items")).orderBy("slot").collect()
        if len(slots) < min(base.n_periods, YEAR):
            raise ValueError("there are fewer months of distributions than the base has")
        if any(r["months"] != 1 for r in slots):
            raise ValueError("the distributions of a slot belong to different months")
        n_items = panel.series.select("item_id").distinct().count()
        if any(r["items"] != n_items for r in slots):
            raise ValueError("the distributions and the base have different numbers of items")
        if slots[0]["month"] != base.start_date.month:
            raise ValueError("the distributions and the base start in different months")

    def prepare(self, panel: Panel) -> Panel:
        by_item = self.matching.filter(F.col("slot") <= YEAR).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("slot", "values", "cum", "guide", "expected"))).alias("_dists"))
        return replace(panel, series=panel.series.join(by_item, "item_id"))

    def _slot(self, t: Column) -> Column:
        return F.get("_dists", F.pmod(t - 1, F.size("_dists")))

    def draw(self, base: Base, at: int, seed: int | Column) -> Column:
        def one(t: Column) -> Column:
            d = self._slot(t)
            return picked(d["values"], d["cum"], d["guide"], uniform(seed, self.stream, "rep", t, "item_id"))

        return _months(self.length(base, at, 1), one)

    def mean(self, base: Base, at: int) -> Column:
        return _months(self.length(base, at, 1), lambda t: self._slot(t)["expected"])


