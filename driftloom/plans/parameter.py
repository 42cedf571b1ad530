"""Population parameters: the trajectory of a measure on expected price changes with a trend imposed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators.measures import Measure, RebasedIndex, TotalIndex, WeightedMean
from ..operators.resample import Resampler, ScrambleByMonth
from ..operators.trend import ExponentialTrend, Trend
from ..sources.panel import Panel

DEFAULT_RESAMPLER = ScrambleByMonth()
#: Stands in for a calibrated random walk, whose table callers pass as ``TableTrend``.
DEFAULT_TREND = ExponentialTrend(0.02)


@dataclass(frozen=True)
class Parameter:
    measure: Measure
    resampler: Resampler = field(default=DEFAULT_RESAMPLER)
    trend: Trend = field(default=DEFAULT_TREND)

    @property
    def tag(self) -> str:
        return f"{self.measure.tag}|{self.resampler.tag}|{self.trend.tag}"

    def trajectory(self, panel: Panel) -> DataFrame:
        """(t_global, date, infl); with folds in the panel also fold."""
        return self.measure.apply(self.trend.apply(self.resampler.population(panel)))


def total_rebase(resampler: Resampler = DEFAULT_RESAMPLER, trend: Trend = DEFAULT_TREND) -> Parameter:
    return Parameter(RebasedIndex(60), resampler, trend)


def total(resampler: Resampler = DEFAULT_RESAMPLER, trend: Trend = DEFAULT_TREND) -> Parameter:
    return Parameter(TotalIndex(), resampler, trend)


def total_legacy_rebase(resampler: Resampler = DEFAULT_RESAMPLER, trend: Trend = DEFAULT_TREND) -> Parameter:
    return Parameter(RebasedIndex(36, 2), resampler, trend)


def weighted_mean(resampler: Resampler = DEFAULT_RESAMPLER, trend: Trend = DEFAULT_TREND) -> Parameter:
    return Parameter(WeightedMean(), resampler, trend)
