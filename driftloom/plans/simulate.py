"""Simulations: replicates, their trajectories and the metrics of these, as one lazy plan each.

Replicates are rows dealt by their number. Folds are a key of the same job, not a loop."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.counter import DEFAULT_SEED
from ..operators import metrics as M
from ..operators.measures import Measure, together
from ..operators.periods import tagged
from ..operators.resample import Resampler
from ..operators.trend import FoldTrend, Trend
from ..sources import store
from ..sources.panel import Panel
from .config import SimConfig, SimDynamicConfig, described


def trajectories(measure: Measure, resampler: Resampler, trend: Trend, panel: Panel, reps: int = 100, seed: int = DEFAULT_SEED) -> DataFrame:
    """(rep, t_global, date, infl[, measure_id]): all measures see the same replicates."""
    return measure.apply(trend.apply(resampler.sample(panel, reps, seed)))


def _errors(config: SimConfig, panel: Panel, seed: int) -> tuple[DataFrame, DataFrame]:
    cut = panel.slice(last=config.traindate)
    traj = trajectories(config.measure, config.resampler, config.trend, cut, config.nsim, seed)
    return M.errors(traj, config.parameter.trajectory(cut)), traj


def lowlevel(panel: Panel, config: SimConfig, seed: int = DEFAULT_SEED, short: bool = False) -> tuple[DataFrame, DataFrame]:
    """Metrics by the tag of each evaluation period, and the trajectories."""
    e, traj = _errors(config, panel, seed)
    keys = ["tag", "measure_id"] if "measure_id" in traj.columns else ["tag"]
    return M.evaluate(tagged(e, config.evalperiods), keys, short), traj


def _settings(seed: int, short: bool | None) -> dict:
    """Settings of a run that are part of its key: those that are not the defaults."""
    return ({"seed": seed} if seed != DEFAULT_SEED else {}) | ({"short": short} if short is not None else {})


def _own(config: SimConfig | SimDynamicConfig, key: str) -> dict:
    """The configuration's own columns of its results."""
    trend = config.trend.tag if isinstance(config, SimConfig) else "DynamicRW"
    return {
        "config_key": key, "name": config.savename(suffix=""), "measure": config.measure.name, "measure_tag": config.measure.tag, "params": repr(config.measure.params),
        "resampler": config.resampler.tag, "trend": trend, "parameter": config.parameter.tag, "nsim": config.nsim, "traindate": config.traindate,
    }


def assessment(panel: Panel, config: SimConfig, seed: int = DEFAULT_SEED, short: bool = False) -> DataFrame:
    """The metrics with the configuration's own columns."""
    found, _ = lowlevel(panel, config, seed, short)
    return found.select(*[F.lit(v).alias(k) for k, v in _own(config, config.key()).items()], *found.columns)


def _groups(configs: dict[str, SimConfig | SimDynamicConfig]) -> list[dict[str, SimConfig | SimDynamicConfig]]:
    """Configurations that see the same replicates: resampler, trend or folds' trends, and training date are the same.

    Draws are functions of a replicate's number, so fewer replicates are the first of more."""
    found: dict[str, dict] = {}
    for key, c in configs.items():
        dynamic = isinstance(c, SimDynamicConfig)
        same = described([c.resampler, [list(map(float, t)) for t in c.trends] if dynamic else c.trend, c.traindate, dynamic])
        found.setdefault(same, {})[key] = c
    return list(found.values())


def _drawn(panel: Panel, configs: dict[str, SimConfig | SimDynamicConfig], seed: int) -> DataFrame:
    """(config_key, [fold,] rep, t_global, date, infl, pi, measure_id) of one group: its replicates are drawn once, all
    measures come from one pass over them, and each configuration takes the rows of its measures and first replicates."""
    one = next(iter(configs.values()))
    most = max(c.nsim for c in configs.values())
    cut = panel.slice(last=one.traindate)
    if isinstance(one, SimDynamicConfig):
        cut, trend, keys = _fold_panel(cut, one.nfolds), _fold_trend(panel, one), ["fold"]
        own_seed = F.lit(seed) + F.col("fold") + one.nfolds
        parameters = {k: replace(c.parameter, trend=trend) for k, c in configs.items()}
    else:
        trend, keys, own_seed = one.trend, [], seed
        parameters = {k: c.parameter for k, c in configs.items()}
    sample = trend.apply(one.resampler.sample(cut, most, own_seed))
    measures = {described(m): m for c in configs.values() for m in c.measure.measures}
    ids = {k: f"m{i}" for i, k in enumerate(measures)}
    joint = {ids[k]: m for k, m in measures.items() if m.joint}
    parts = [together(sample, joint)] if joint else []
    parts += [m.apply(sample).withColumn("measure_id", F.lit(ids[k])) for k, m in measures.items() if not m.joint]
    traj = reduce(DataFrame.unionByName, parts)
    populations = {described([c.parameter.measure, c.parameter.resampler, keys or c.parameter.trend]): k for k, c in configs.items()}
    which = {name: i for i, name in enumerate(populations)}
    pis = [parameters[k].trajectory(cut).select(*keys, "t_global", F.col("infl").alias("pi"), F.lit(i).alias("_p")) for i, k in enumerate(populations.values())]
    rows = []
    for key, c in configs.items():
        p = which[described([c.parameter.measure, c.parameter.resampler, keys or c.parameter.trend])]
        rows += [(key, ids[described(m)], m.tag if len(c.measure.measures) > 1 else None, p, c.nsim) for m in c.measure.measures]
    # a few rows for each configuration, some months for each parameter
    wanted = panel.spark.createDataFrame(rows, "config_key string, measure_id string, _tag string, _p int, _nsim int")
    out = traj.join(F.broadcast(wanted), "measure_id").filter("rep <= _nsim").join(F.broadcast(reduce(DataFrame.unionByName, pis)), [*keys, "t_global", "_p"])
    return out.select("config_key", *keys, "rep", "t_global", "date", "infl", "pi", F.col("_tag").alias("measure_id"))


def _evaluated(drawn: DataFrame, configs: dict[str, SimConfig | SimDynamicConfig], short: bool) -> DataFrame:
    """The assessment rows of one group, from the rows of ``_drawn``."""
    by_periods: dict[tuple, list[str]] = {}
    for key, c in configs.items():
        by_periods.setdefault((c.evalperiod,) if isinstance(c, SimDynamicConfig) else tuple(c.evalperiods), []).append(key)
    tags = None
    for periods, keys in by_periods.items():
        here = F.col("config_key").isin(keys)
        own = F.array_compact(F.array(*[F.when(p.mask(), F.lit(p.tag)) for p in periods]).cast("array<string>"))
        tags = F.when(here, own) if tags is None else tags.when(here, own)
    dynamic = "fold" in drawn.columns
    several = any(len(c.measure.measures) > 1 for c in configs.values())
    keys = ["config_key", "fold" if dynamic else "tag", *["measure_id"] * several]
    e = drawn.withColumn("e", F.col("infl") - F.col("pi")).withColumn("tag", F.explode(tags))
    found = M.evaluate(e, keys, short)
    own = [_own(c, key) for key, c in configs.items()]
    kinds = {"nsim": "int", "traindate": "date"}
    info = drawn.sparkSession.createDataFrame([tuple(x.values()) for x in own], ", ".join(f"{k} {kinds.get(k, 'string')}" for k in own[0]))
    return found.join(F.broadcast(info), "config_key").select(*own[0], *[c for c in found.columns if c != "config_key"])


def evaluate_batch(panel: Panel, configs: Sequence[SimConfig | SimDynamicConfig], seed: int = DEFAULT_SEED, short: bool = True) -> DataFrame:
    """The assessment of many configurations, a job for each group that shares its replicates (see ``_groups``).

    One row for each configuration and tag or fold, and measure of an ensemble; columns that some lack are null there."""
    keyed = {c.key(**_settings(seed, None if short else short)): c for c in configs}
    parts = [_evaluated(_drawn(panel, group, seed), group, short) for group in _groups(keyed)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def assessment_batch(panel: Panel, configs: Sequence[SimConfig | SimDynamicConfig], path: str, seed: int = DEFAULT_SEED, short: bool = True, recompute: bool = False, trajectories_path: str | None = None) -> list[str]:
    """Write the assessment of each configuration, static or dynamic (one row a fold), that the store lacks; returns the keys written.

    Configurations that share their replicates are drawn and evaluated together. Keys tell runs of another seed or of all
    metrics apart. With ``trajectories_path`` the trajectories are written there first, under the same keys, and the metrics
    are those of the trajectories written."""
    spark = panel.spark
    keyed = {c.key(**_settings(seed, None if short else short)): c for c in configs}
    have = set() if recompute else store.present_keys(spark, path, list(keyed))
    todo = {k: c for k, c in keyed.items() if k not in have}
    for group in _groups(todo):
        drawn = _drawn(panel, group, seed)
        if trajectories_path:
            store.save(drawn, trajectories_path)
            drawn = spark.read.schema(drawn.schema).parquet(trajectories_path).filter(F.col("config_key").isin(list(group)))
        store.save(_evaluated(drawn, group, short), path)
    return list(todo)


def assessment_store(panel: Panel, configs: Sequence[SimConfig | SimDynamicConfig], kept: store.Store, seed: int = DEFAULT_SEED, short: bool = True, recompute: bool = False) -> list[str]:
    """``assessment_batch`` into a ``Store``: metrics and trajectories of a group appear together; returns the keys written.

    The metrics are computed from the trajectories as written, so replicates are drawn once."""
    keyed = {c.key(**_settings(seed, None if short else short)): c for c in configs}
    have = set() if recompute else kept.present(list(keyed))
    todo = {k: c for k, c in keyed.items() if k not in have}
    for group in _groups(todo):
        kept.commit_with(_drawn(panel, group, seed), "trajectories", lambda drawn, group=group: {"metrics": _evaluated(drawn, group, short)}, list(group))
    return list(todo)


def _fold_panel(panel: Panel, nfolds: int) -> Panel:
    folds = panel.spark.range(1, nfolds + 1).select(F.col("id").cast("int").alias("fold"))
    return replace(panel, series=panel.series.crossJoin(F.broadcast(folds)), keys=(*panel.keys, "fold"))


def _fold_trend(panel: Panel, config: SimDynamicConfig) -> FoldTrend:
    rows = [(i, [float(x) for x in t]) for i, t in enumerate(config.trends, 1)]
    return FoldTrend(panel.spark.createDataFrame(rows, "fold int, factors array<double>"))


def lowlevel_dynamic(panel: Panel, config: SimDynamicConfig, seed: int = DEFAULT_SEED, short: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metrics by fold, trajectories (fold, rep, ...) and population trajectories (fold, ...); fold i draws by the seed
    ``seed + i + nfolds``."""
    cut = _fold_panel(panel.slice(last=config.traindate), config.nfolds)
    trend = _fold_trend(panel, config)
    population = replace(config.parameter, trend=trend).trajectory(cut)
    own_seed = F.lit(seed) + F.col("fold") + config.nfolds
    traj = config.measure.apply(trend.apply(config.resampler.sample(cut, config.nsim, own_seed)))
    e = M.errors(traj, population, ("fold", "t_global")).filter(config.evalperiod.mask())
    return M.evaluate(e, ["fold"], short), traj, population


@dataclass(frozen=True)
class DynamicResult:
    config: SimDynamicConfig
    metrics: DataFrame
    by_metric: DataFrame
    summary: DataFrame
    trajectories: DataFrame
    population: DataFrame


def assessment_dynamic(panel: Panel, config: SimDynamicConfig, seed: int = DEFAULT_SEED, short: bool = False) -> DynamicResult:
    """Metrics by fold, merged into one row a metric, with all folds' trajectories under one replicate number."""
    found, traj, population = lowlevel_dynamic(panel, config, seed, short)
    names = M.SHORT if short else M.FULL
    every = traj.withColumn("rep_global", (F.col("fold") - 1) * config.nsim + F.col("rep"))
    return DynamicResult(config, found, M.merged_folds(found, names), M.fold_summary(found), every, population)


def _online(measure: Measure, resampler: Resampler, trend: Trend, panel: Panel, population: DataFrame, reps: int, seed: int, metric: str) -> DataFrame:
    e = M.errors(trajectories(measure, resampler, trend, panel, reps, seed), population)
    return M.evaluate(e, short=True).select(metric)


def online(metric: str, config: SimConfig | None, panel: Panel, reps: int = 1000, seed: int = DEFAULT_SEED, *, parts: tuple[Measure, Resampler, Trend] | None = None, population: DataFrame | None = None) -> DataFrame:
    """One metric (mse, absme or corr) over all months of the panel, by partial aggregates; the configuration's training
    date, periods and number of simulations do not matter. ``parts`` and a ``population`` replace a configuration."""
    if metric not in ("mse", "absme", "corr"):
        raise ValueError(f"no online metric {metric}")
    if config is not None:
        parts = (config.measure, config.resampler, config.trend)
        population = config.parameter.trajectory(panel)
    if parts is None or population is None:
        raise ValueError("a configuration, or parts and a population trajectory, are needed")
    return _online(*parts, panel, population, reps, seed, metric)


