"""Trends: positive factors by month that multiply price rises."""

from __future__ import annotations

import datetime as dt
import math
from abc import ABC
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.counter import DEFAULT_SEED, normal
from ..functions.scalar import positive
from ..sources.panel import Panel


class Trend(ABC):
    """``factor`` is the factor of month t (counted over all bases from 1) as a column expression."""

    name: str
    tag: str

    def factor(self, t: Column) -> Column | None:
        """None leaves the panel as it is."""
        raise NotImplementedError

    def apply(self, panel: Panel) -> Panel:
        """Changes above 0 times their month's factor, others as they are."""
        if self.factor(F.lit(1)) is None:
            return panel
        offset = panel.per_base(panel.offsets())
        return panel.with_values(F.transform("vals", lambda v, i: F.when(positive(v), v * self.factor(i + 1 + offset)).otherwise(v)))

    def factors(self, spark: SparkSession, n: int) -> DataFrame:
        """(t_global, factor) of months 1..n."""
        out = spark.range(1, n + 1).select(F.col("id").cast("int").alias("t_global"))
        f = self.factor(F.col("t_global"))
        return out.withColumn("factor", F.lit(1.0) if f is None else f)

    def __repr__(self) -> str:
        return f"{self.name} ({self.tag})"


@dataclass(frozen=True, repr=False)
class IdentityTrend(Trend):
    name = "Identity"
    tag = "ID"

    def factor(self, t: Column) -> None:
        return None


@dataclass(frozen=True, repr=False)
class AnalyticTrend(Trend):
    """f of the month's number, a function from column to column."""

    f: Callable[[Column], Column]
    name: str = "Analytic"
    tag = "TA"

    def factor(self, t: Column) -> Column:
        return self.f(t)


@dataclass(frozen=True, repr=False)
class ExponentialTrend(Trend):
    """A constant yearly rate, at most 1."""

    rate: float = 0.02
    name = "Exponential"

    def __post_init__(self) -> None:
        if self.rate > 1:
            raise ValueError("a rate is given as a share, at most 1")

    @property
    def tag(self) -> str:
        return f"EXP{round(100 * self.rate, 2):g}%"

    def factor(self, t: Column) -> Column:
        return F.pow(F.lit((1 + self.rate) ** (1 / 12)), t)


@dataclass(frozen=True, repr=False)
class TableTrend(Trend):
    """Given factors by month, such as a calibrated random walk; few enough to stand in the plan."""

    values: Sequence[float]
    name: str = "Random walk"
    tag: str = "RW"

    def factor(self, t: Column) -> Column:
        return F.element_at(F.array(*[F.lit(float(v)) for v in self.values]), t.cast("int"))


@dataclass(frozen=True, repr=False)
class FoldTrend(Trend):
    """One vector of factors for each fold, from a table (fold, factors) that is joined by fold."""

    table: DataFrame
    name: str = "Dynamic random walk"
    tag: str = "DRW"

    def apply(self, panel: Panel) -> Panel:
        joined = replace(panel, series=panel.series.join(F.broadcast(self.table.select("fold", F.col("factors").alias("_f"))), "fold"))
        offset = panel.per_base(panel.offsets())
        out = joined.with_values(F.transform("vals", lambda v, i: F.when(positive(v), v * F.get("_f", i + offset)).otherwise(v)))
        return replace(out, series=out.series.drop("_f"))

    def factor(self, t: Column) -> Column:
        raise ValueError("a fold's trend is applied to panels with folds")


#: Blocks of candidates that ``generated`` makes for all folds at once.
FIRST_BLOCKS = 4


def zero_mean(y: Column, atol: float = 0.1) -> Column:
    """Whether the mean of the array y is 0 within ``atol``."""
    return F.abs(F.aggregate(y, F.lit(0.0), lambda acc, x: acc + x) / F.size(y)) <= atol


def generated(spark: SparkSession, nfolds: int, length: int = 360, phi: float = 1.0, sigma: float = 0.05, accept: Callable[[Column], Column] = zero_mean, seed: int = DEFAULT_SEED, block: int = 32, most_blocks: int = 64) -> DataFrame:
    """(fold, candidate, y, factors): for each fold the first autoregressive path that ``accept`` takes.

    y_1 = sigma e_1, y_t = phi y_(t-1) + sigma e_t; factors are exp(y). One plan makes ``FIRST_BLOCKS`` blocks of candidates
    for all folds, a row each, dealt over tasks; another makes the rest for the folds that then have none, if any. After
    ``most_blocks`` blocks a RuntimeError says which folds have none. Only the accepted paths reach the driver."""

    def first(folds: Sequence[int], numbers: range) -> list[tuple]:
        paths = candidates(spark, folds, numbers, length, phi, sigma, seed).filter(accept(F.col("y")))
        return [(r["fold"], r["p"]["candidate"], r["p"]["y"]) for r in paths.groupBy("fold").agg(F.min_by(F.struct("candidate", "y"), "candidate").alias("p")).collect()]

    early = min(FIRST_BLOCKS, most_blocks) * block
    found = first(range(1, nfolds + 1), range(1, early + 1))
    lacking = sorted(set(range(1, nfolds + 1)) - {r[0] for r in found})
    if lacking and early < most_blocks * block:
        found += first(lacking, range(early + 1, most_blocks * block + 1))
        lacking = sorted(set(range(1, nfolds + 1)) - {r[0] for r in found})
    if lacking:
        raise RuntimeError(f"no accepted path for folds {lacking} in {most_blocks * block} candidates")
    return spark.createDataFrame(sorted(found), "fold int, candidate int, y array<double>").withColumn("factors", F.transform("y", F.exp))


def autoregression(y: DataFrame, order: str = "t_global", value: str = "y") -> tuple[float, float]:
    """(phi, sigma) of y_t = phi y_(t-1) + sigma e_t by least squares over the rows of a short series."""
    pairs = y.select(F.col(value).alias("a"), F.lag(value).over(Window.orderBy(order)).alias("b")).filter("b is not null")
    phi, n, yy, yb, bb = pairs.agg(F.try_divide(F.sum(F.col("a") * F.col("b")), F.sum(F.col("b") * F.col("b"))), F.count("*"), F.sum(F.col("a") * F.col("a")), F.sum(F.col("a") * F.col("b")), F.sum(F.col("b") * F.col("b"))).first()
    if phi is None:
        raise ValueError("the series is too short, or 0 throughout")
    return phi, math.sqrt(max(yy - 2 * phi * yb + phi * phi * bb, 0) / max(n - 1, 1))


def log_level(panel: Panel) -> DataFrame:
    """(t_global, y): the log of the weighted mean price level against its own straight line, as a trend's log factor."""
    monthly = panel.changes().groupBy("t_global").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m"))
    order = Window.orderBy("t_global")  # one row a month
    level = monthly.select("t_global", F.sum(F.log1p(F.col("m") / 100)).over(order).alias("_l"))
    slope = F.max_by("_l", "t_global").over(Window.partitionBy()) / F.max("t_global").over(Window.partitionBy())
    return level.select("t_global", (F.col("_l") - slope * F.col("t_global")).alias("y"))


def candidates(spark: SparkSession, folds: Sequence[int], numbers: Sequence[int], length: int, phi: float, sigma: float, seed: int = DEFAULT_SEED) -> DataFrame:
    """(fold, candidate, y): autoregressive paths of folds and consecutive numbers, dealt over tasks."""
    n = len(numbers)
    fold = F.element_at(F.array(*[F.lit(int(f)) for f in folds]), (F.expr(f"id div {n}") + 1).cast("int"))
    grid = spark.range(len(folds) * n).select(fold.alias("fold"), (F.col("id") % n + numbers[0]).cast("int").alias("candidate"))
    shocks = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda t: sigma * normal(seed, "drw", "fold", "candidate", t))
    step = F.aggregate(
        "_e",
        F.array().cast("array<double>"),
        lambda acc, e: F.array_append(acc, phi * F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + e),
    )
    return grid.withColumn("_e", shocks).select("fold", "candidate", step.alias("y"))


def latest_file(files: DataFrame, path: str = "path") -> DataFrame:
    """The row whose path, ``RWTREND <date>.<ending>``, has the latest date."""
    dated = files.withColumn("date", F.regexp_extract(F.col(path), r"RWTREND (\d{4}-\d{2}-\d{2})\.", 1).try_cast("date"))
    return dated.filter("date is not null").groupBy().agg(F.max_by(path, "date").alias(path), F.max("date").alias("date"))


def write_calibrated(y: DataFrame, folder: str, date: dt.date) -> None:
    """Write (t_global, y), log factors by month, as the calibration of a date; an older one of that date is replaced."""
    y.select("t_global", "y").coalesce(1).write.mode("overwrite").parquet(f"{folder}/RWTREND {date}.parquet")


def calibrated(spark: SparkSession, folder: str) -> DataFrame:
    """(t_global, y, date) of the latest ``RWTREND <date>.parquet`` in a folder; each may be a file or a folder of files.

    Only names are listed to find it, and only its files are read."""
    try:
        names = spark.read.format("binaryFile").load(f"{folder}/RWTREND *.parquet").select("path")
        found = latest_file(names.select(F.regexp_extract(F.regexp_replace("path", "%20", " "), r"^(.*RWTREND \d{4}-\d{2}-\d{2}\.parquet)", 1).alias("path"))).first()
    except AnalysisException:
        found = None
    if not found or not found["path"]:
        raise FileNotFoundError(f"no calibrated trend in {folder}")
    return spark.read.parquet(found["path"]).select("t_global", "y", F.lit(found["date"]).alias("date"))


def read_calibrated(spark: SparkSession, folder: str) -> TableTrend:
    """``calibrated`` as a trend: some factors a year."""
    return TableTrend([r["factor"] for r in calibrated(spark, folder).orderBy("t_global").select(F.exp("y").alias("factor")).collect()])


def offsets_of(periods: DataFrame) -> DataFrame:
    """(base_id, first, last): the months of the trend that each base of (base_id, ord, n_periods) takes."""
    upto = F.sum("n_periods").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return periods.select("base_id", (upto - F.col("n_periods") + 1).alias("first"), upto.alias("last"))


def sine(t: Column) -> Column:
    """One plus a sine wave of a year."""
    return 1 + F.sin(2 * math.pi * t / 12)
