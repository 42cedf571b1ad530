"""Simulation configurations and the names of their results."""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import inspect
import types
from collections.abc import Sequence
from dataclasses import dataclass, fields, is_dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.measures import Measure
from ..operators.periods import DEFAULT_PERIODS, CompletePeriod, Period
from ..operators.resample import Resampler
from ..operators.trend import Trend
from .parameter import Parameter

SEPARATOR, SUFFIX = ", ", ".parquet"
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def date_tag(day: dt.date) -> str:
    """Month and year, whatever the locale."""
    return f"{MONTHS[day.month - 1]}{day.year % 100:02d}"


def count_tag(n: int) -> str:
    """Thousands are written with a k."""
    return f"{n // 1000}k" if n >= 1000 else str(n)


def _file(prefix: str, parts: Sequence[str], suffix: str) -> str:
    return f"{prefix}_" * bool(prefix) + SEPARATOR.join(parts) + suffix


def _code(code: types.CodeType) -> str:
    inner = [_code(c) if isinstance(c, types.CodeType) else repr(sorted(map(repr, c)) if isinstance(c, frozenset) else c) for c in code.co_consts]
    return f"({code.co_code.hex()}, {inner}, {code.co_names}, {code.co_varnames})"


def _function(f: types.FunctionType) -> str:
    """A function by what it does and holds: its code, default values and the values that it closes over."""
    own = inspect.unwrap(f)
    cells = [c.cell_contents for c in own.__closure__ or ()]
    held = [f"{own.__module__}.{own.__qualname__}" if c is own else described(c) for c in cells]
    return f"{own.__module__}.{own.__qualname__}{_code(own.__code__)}, {described(own.__defaults__)}, {described(own.__kwdefaults__)}, {held}"


def described(value) -> str:
    """All that a value holds, field by field; tables by their schema and rows."""
    if isinstance(value, DataFrame):
        names = sorted(value.columns)
        h = F.xxhash64(*[F.col(f"`{n}`") for n in names]).cast("decimal(38,0)")
        return f"table({value.schema.simpleString()}, {value.select(F.count('*'), F.sum(h)).first()})"
    if isinstance(value, (str, bytes, int, float, bool, dt.date, type(None))):
        return repr(value)
    if isinstance(value, dict):
        return "{" + ", ".join(sorted(f"{described(k)}: {described(v)}" for k, v in value.items())) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(described, value)) + "]"
    if hasattr(value, "tolist"):
        return described(value.tolist())
    if isinstance(value, functools.partial):
        return f"partial({described(value.func)}, {described(value.args)}, {described(value.keywords)})"
    if hasattr(value, "__code__"):
        return _function(value)
    if hasattr(value, "__func__"):  # a bound method
        return f"{described(value.__self__)}.{_function(value.__func__)}"
    if callable(value) and hasattr(value, "__qualname__"):
        return f"{value.__module__}.{value.__qualname__}"
    own = {f.name: getattr(value, f.name) for f in fields(value)} if is_dataclass(value) else vars(value)
    return f"{type(value).__module__}.{type(value).__qualname__}{described(own)}"


def _key(config, settings: dict) -> str:
    return hashlib.md5((described(config) + described(settings) * bool(settings)).encode()).hexdigest()


@dataclass(frozen=True)
class SimConfig:
    """One simulation; without ``evalperiods`` the complete period alone."""

    measure: Measure
    resampler: Resampler
    trend: Trend
    parameter: Parameter
    nsim: int
    traindate: dt.date
    evalperiods: tuple[Period, ...] = (CompletePeriod(),)

    @classmethod
    def with_default_periods(cls, *args) -> SimConfig:
        return cls(*args, evalperiods=DEFAULT_PERIODS)

    def tags(self) -> list[str]:
        return [self.measure.tag, self.resampler.tag, self.trend.tag, self.parameter.measure.tag, count_tag(self.nsim), date_tag(self.traindate)]

    def savename(self, prefix: str = "", suffix: str = SUFFIX) -> str:
        return _file(prefix, self.tags(), suffix)

    def key(self, **settings) -> str:
        """Unlike the name, differs for configurations that differ in any field, and for other ``settings`` of a run."""
        return _key(self, settings)


@dataclass(frozen=True)
class SimDynamicConfig:
    """One simulation over several folds, each with a trend of its own."""

    measure: Measure
    resampler: Resampler
    trends: Sequence[Sequence[float]]
    parameter: Parameter
    nsim: int
    traindate: dt.date
    evalperiod: Period = CompletePeriod()

    @property
    def nfolds(self) -> int:
        return len(self.trends)

    def tags(self) -> list[str]:
        return [self.measure.tag, self.resampler.tag, "DynamicRW", self.parameter.measure.tag, str(self.nfolds), count_tag(self.nsim), date_tag(self.traindate), self.evalperiod.tag or "CompletePeriod"]

    def savename(self, prefix: str = "", suffix: str = SUFFIX) -> str:
        return _file(prefix, self.tags(), suffix)

    def key(self, **settings) -> str:
        return _key(self, settings)


def from_dict(values: dict) -> SimConfig | SimDynamicConfig:
    """A configuration of named values; ``trends`` makes it dynamic. Six static values get the default periods."""
    kind = SimDynamicConfig if "trends" in values else SimConfig
    optional = {"evalperiod", "evalperiods"}
    missing = [f.name for f in fields(kind) if f.name not in values and f.name not in optional]
    if missing:
        raise ValueError(f"missing: {', '.join(missing)}")
    unknown = set(values) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown: {', '.join(sorted(unknown))}")
    values = dict(values)
    if kind is SimConfig:
        values.setdefault("evalperiods", DEFAULT_PERIODS)
        values["evalperiods"] = tuple(values["evalperiods"])
    return kind(**values)


def from_dicts(values: dict | Sequence[dict]):
    return from_dict(values) if isinstance(values, dict) else [from_dict(v) for v in values]
