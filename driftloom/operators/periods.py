"""Evaluation periods as predicates on dates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Period:
    tag: str = ""

    def ranges(self) -> list[tuple[dt.date, dt.date]]:
        return []

    def mask(self, date: Column | str = "date") -> Column:
        return F.lit(True)

    def __iter__(self) -> Iterator[Period]:
        yield self


@dataclass(frozen=True)
class CompletePeriod(Period):
    """All months; its tag is empty."""


@dataclass(frozen=True)
class EvalPeriod(Period):
    start: dt.date = dt.date.min
    final: dt.date = dt.date.max
    tag: str = "period"

    def ranges(self) -> list[tuple[dt.date, dt.date]]:
        return [(self.start, self.final)]

    def mask(self, date: Column | str = "date") -> Column:
        date = F.col(date) if isinstance(date, str) else date
        return date.between(F.lit(self.start), F.lit(self.final))


@dataclass(frozen=True)
class PeriodVector(Period):
    """Months in any of several ranges; overlaps count once."""

    parts: Sequence[tuple[dt.date, dt.date]] = ()
    tag: str = "periods"

    def ranges(self) -> list[tuple[dt.date, dt.date]]:
        return list(self.parts)

    def mask(self, date: Column | str = "date") -> Column:
        date = F.col(date) if isinstance(date, str) else date
        return reduce(lambda a, b: a | b, (date.between(F.lit(a), F.lit(b)) for a, b in self.parts), F.lit(False))


# Default evaluation periods.
B00 = EvalPeriod(start=dt.date(2001, 12, 1), final=dt.date(2010, 12, 1), tag="b00")
B10 = EvalPeriod(start=dt.date(2011, 12, 1), final=dt.date(2023, 12, 1), tag="b10")
T0010 = EvalPeriod(start=dt.date(2011, 1, 1), final=dt.date(2011, 11, 1), tag="t0010")
DEFAULT_PERIODS = (CompletePeriod(), B00, T0010, B10)


def eval_periods(trajectory: DataFrame, period: Period) -> DataFrame:
    return trajectory.filter(period.mask())


def period_table(spark: SparkSession, periods: Sequence[Period]) -> DataFrame:
    """(tag, start_date, end_date), one row a range."""
    rows = [(p.tag, a, b) for p in periods for a, b in (p.ranges() or [(dt.date(1, 1, 1), dt.date(9999, 12, 1))])]
    return spark.createDataFrame(rows, "tag string, start_date date, end_date date")


def tagged(trajectory: DataFrame, periods: Sequence[Period]) -> DataFrame:
    """Each row once for every period that it lies in, with the column tag: all periods are evaluated in one job."""
    tags = F.array_compact(F.array(*[F.when(p.mask(), F.lit(p.tag)) for p in periods]))
    return trajectory.withColumn("tag", F.explode(tags))
