"""Registered queries over the driver's tables, each with its SQL twin where SQL can express it.

Doubles are rounded, integers are longs: values then compare equal across engines."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.counter import DEFAULT_SEED
from ..functions.scalar import soft_threshold
from ..operators import combine as C
from ..operators import matching as G
from ..operators import metrics as M
from ..operators import resample as R
from ..operators import trend as D
from ..operators.measures import Ensemble, Measure, PercentileEq, PercentileWeighted, RebasedIndex, TotalIndex, WeightedMean
from ..operators.periods import CompletePeriod, EvalPeriod, PeriodVector, tagged
from ..operators.selection import percentiles_of
from ..sources import store
from ..sources.panel import THREE_BASES, TWO_BASES, Panel, sales_panel
from . import oracle as S
from .config import SimConfig, SimDynamicConfig
from .parameter import Parameter, total, total_legacy_rebase, total_rebase, weighted_mean
from .simulate import assessment, assessment_dynamic, assessment_store, evaluate_batch, lowlevel, lowlevel_dynamic, online, trajectories

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

REPS, SMALL = 20, 5
P1 = EvalPeriod(start=dt.date(1997, 1, 1), final=dt.date(1998, 12, 1), tag="p1")
P2 = EvalPeriod(start=dt.date(1999, 1, 1), final=dt.date(2001, 10, 1), tag="p2")
MULTI = PeriodVector(parts=((dt.date(1997, 1, 1), dt.date(1997, 12, 1)), (dt.date(2000, 6, 1), dt.date(2001, 5, 1))), tag="multi")
LAST = dt.date(2000, 12, 1)
EXT = (40, 50)
PROBS = (0.7, 0.4)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    kinds = {T.DoubleType: lambda c: F.round(c, digits), T.FloatType: lambda c: F.round(c.cast("double"), digits), T.IntegerType: lambda c: c.cast("long")}
    return df.select(*[kinds.get(type(f.dataType), lambda c: c)(F.col(f.name)).alias(f.name) for f in df.schema.fields])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _long(p: Panel) -> DataFrame:
    return rounded(p.changes().select(*p.keys, "base_id", "t", "t_global", "date", "item_id", "v"))


CELLS = "CAST(base_id AS BIGINT) AS base_id, CAST(t AS BIGINT) AS t, CAST(t_global AS BIGINT) AS t_global, date, item_id, round(v, 6) AS v"
DRAWN = "CAST(rep AS BIGINT) AS rep, " + CELLS


def _panel_query(name: str, make: Callable[[Panel], Panel], parts: Sequence[str], final: str, bases=TWO_BASES) -> None:
    query(name, S.build([S.panel(bases), *parts], final))(lambda spark, d: _long(make(sales_panel(spark, d, bases))))


# panels ------------------------------------------------------------------------------------------------------------

_panel_query("panel_monthly_changes", lambda p: p, [], f"SELECT {CELLS} FROM panel")
_panel_query("slice_traindate", lambda p: p.slice(last=LAST), [], f"SELECT {CELLS} FROM panel WHERE date <= DATE '{LAST}'")


@query("panel_items", S.build([S.panel()], "SELECT CAST(base_id AS BIGINT) AS base_id, count(DISTINCT item_id) AS n_items, round(sum(w), 6) AS total_w FROM weights GROUP BY base_id"))
def panel_items(spark: SparkSession, d: str) -> DataFrame:
    p = sales_panel(spark, d)
    return rounded(p.items().join(p.series.groupBy("base_id").agg(F.sum("w").alias("total_w")), "base_id"))


# resampling --------------------------------------------------------------------------------------------------------

SVM, ESVM, RST, RSTI = R.ScrambleByMonth(), R.ExtendedScramble(EXT), R.WeightedScramble(0.6), R.WeightedScrambleByBase(PROBS)
SVM_SQL = S.scramble("sample", REPS)
_BASE_P = f"(CASE base_id WHEN 1 THEN {PROBS[0]} ELSE {PROBS[1]} END)"
_AVERAGE = "avg(v) OVER (PARTITION BY base_id, item_id, (t - 1) % 12)"


def _expected(p: str) -> str:
    size = "count(*) OVER (PARTITION BY base_id, item_id, (t - 1) % 12)"
    return f"CASE WHEN {size} = 1 THEN v ELSE {p} * v + (1 - {p}) / greatest({size} - 1, 1) * (sum(v) OVER (PARTITION BY base_id, item_id, (t - 1) % 12) - v) END AS v"


_TARGET = S.extended(EXT)
_EXT_POP = "SELECT x.base_id, x.t, x.t_global, x.date, x.item_id, x.w, a.v FROM target x JOIN (SELECT DISTINCT base_id, item_id, (t - 1) % 12 AS s, avg(v) OVER (PARTITION BY base_id, item_id, (t - 1) % 12) AS v FROM panel) a ON a.base_id = x.base_id AND a.item_id = x.item_id AND a.s = (x.t - 1) % 12"

_panel_query("resample_svm", lambda p: SVM.sample(p, REPS), [SVM_SQL], f"SELECT {DRAWN} FROM sample")
_panel_query("resample_svm_population", SVM.population, [S.population()], f"SELECT {CELLS} FROM pop")
_panel_query("resample_extended", lambda p: ESVM.sample(p, SMALL), [_TARGET, S.scramble("sample", SMALL, "esvm", "target")], f"SELECT {DRAWN} FROM sample")
_panel_query("resample_extended_population", ESVM.population, [_TARGET], f"SELECT {CELLS} FROM ({_EXT_POP})")
_panel_query("resample_weighted", lambda p: RST.sample(p, REPS), [S.weighted("sample", "0.6", REPS)], f"SELECT {DRAWN} FROM sample")
_panel_query("resample_weighted_population", RST.population, [], f"SELECT {CELLS} FROM (SELECT base_id, t, t_global, date, item_id, {_expected('0.6')} FROM panel)")
_panel_query("resample_per_base_p", lambda p: RSTI.sample(p, REPS), [S.weighted("sample", _BASE_P, REPS, "rsti")], f"SELECT {DRAWN} FROM sample")
_panel_query("resample_per_base_p_population", RSTI.population, [], f"SELECT {CELLS} FROM (SELECT base_id, t, t_global, date, item_id, {_expected(_BASE_P)} FROM panel)")
_panel_query("resample_identity", lambda p: R.Identity().sample(p, 3), [], f"SELECT {DRAWN} FROM panel CROSS JOIN range(1, 4) r(rep)")

MIX = R.Mixture((R.Identity(), SVM, RST))
_MIX = [S.scramble("two", SMALL, where="base_id = 2"), S.weighted("three", "0.6", SMALL, where="base_id = 3")]
_MIXED = f"SELECT {DRAWN} FROM (SELECT rep, base_id, t, t_global, date, item_id, v FROM panel CROSS JOIN range(1, {SMALL + 1}) r(rep) WHERE base_id = 1 UNION ALL SELECT rep, base_id, t, t_global, date, item_id, v FROM two UNION ALL SELECT rep, base_id, t, t_global, date, item_id, v FROM three)"
_panel_query("resample_mixture", lambda p: MIX.sample(p, SMALL), _MIX, _MIXED, THREE_BASES)
_MIX_POP = f"SELECT {CELLS} FROM (SELECT base_id, t, t_global, date, item_id, CASE base_id WHEN 1 THEN v WHEN 2 THEN a ELSE e END AS v FROM (SELECT *, {_AVERAGE} AS a, {_expected('0.6').replace(' AS v', ' AS e')} FROM panel))"
_panel_query("resample_mixture_population", MIX.population, [], _MIX_POP, THREE_BASES)


@query("rechain_dates", S.build([S.panel(), _TARGET], "SELECT DISTINCT CAST(base_id AS BIGINT) AS base_id, min(date) OVER (PARTITION BY base_id) AS start_date, max(date) OVER (PARTITION BY base_id) AS end_date, CAST(max(t) OVER (PARTITION BY base_id) AS BIGINT) AS n_periods FROM target"))
def rechain_dates(spark: SparkSession, d: str) -> DataFrame:
    p = ESVM.population(sales_panel(spark, d)).changes()
    return rounded(p.groupBy("base_id").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.max("t").alias("n_periods")))


# matched distributions ---------------------------------------------------------------------------------------------

_OBS = "obs AS (SELECT item_id, month(date) AS month, v AS value, base_id = 2 AS is_actual FROM panel)"
_SD = "(0.35 * stddev_samp(value) OVER k + 0.0001)"
_WEIGHT = {
    "synthetic": f"exp(-0.5 * pow(abs(value - avg(CASE WHEN is_actual THEN value END) OVER k) / {_SD}, 2)) / ({_SD} * sqrt(2 * pi()))",
    "prior": "CAST(max(CASE WHEN is_actual THEN 0 ELSE 1 END) OVER (PARTITION BY item_id, month, value) AS DOUBLE)",
    "actual": "CAST(max(CASE WHEN is_actual THEN 1 ELSE 0 END) OVER (PARTITION BY item_id, month, value) AS DOUBLE)",
}


def _dist(kind: str) -> list[str]:
    return [
        _OBS,
        f"raw AS (SELECT *, {_WEIGHT[kind]} AS rw FROM obs WINDOW k AS (PARTITION BY item_id, month))",
        "dist0 AS (SELECT item_id, month, row_number() OVER (PARTITION BY item_id, month ORDER BY value, is_actual) AS idx, value, rw / sum(rw) OVER (PARTITION BY item_id, month) AS weight, is_actual FROM raw)",
        "dist1 AS (SELECT *, CASE WHEN idx = max(idx) OVER (PARTITION BY item_id, month) THEN 1.0 ELSE sum(weight) OVER (PARTITION BY item_id, month ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS cum_hi FROM dist0)",
        "dist AS (SELECT *, coalesce(lag(cum_hi) OVER (PARTITION BY item_id, month ORDER BY idx), 0.0) AS cum_lo FROM dist1)",
    ]


_WEIGHINGS = {"synthetic": G.synthetic_weights, "prior": G.prior_weights, "actual": G.actual_weights}


def _matching(spark: SparkSession, d: str, kind: str = "synthetic") -> DataFrame:
    p = sales_panel(spark, d)
    return G.build(G.observations(p.slice(last=TWO_BASES[0].end_date), p.slice(first=TWO_BASES[1].start_date)), _WEIGHINGS[kind])


for _kind in _WEIGHINGS:
    query(
        f"match_{_kind}_weights",
        S.build([S.panel(), *_dist(_kind)], "SELECT item_id, CAST(month AS BIGINT) AS month, CAST(idx AS BIGINT) AS idx, round(value, 6) AS value, round(weight, 6) AS weight, round(cum_lo, 6) AS cum_lo, round(cum_hi, 6) AS cum_hi, is_actual FROM dist"),
    )(lambda spark, d, kind=_kind: rounded(_matching(spark, d, kind)))

_STATS = """SELECT item_id, CAST(month AS BIGINT) AS month, n, round(mean, 6) AS mean, round(CASE WHEN k > 1 THEN sqrt(k / (k - 1.0) * s) ELSE CAST('NaN' AS DOUBLE) END, 6) AS std FROM (
  SELECT item_id, month, count(*) AS n, max(mu) AS mean, count_if(weight <> 0) AS k, sum(weight * (value - mu) * (value - mu)) AS s
  FROM (SELECT *, sum(value * weight) OVER (PARTITION BY item_id, month) / sum(weight) OVER (PARTITION BY item_id, month) AS mu FROM dist) GROUP BY ALL)"""


@query("match_stats", S.build([S.panel(), *_dist("synthetic")], _STATS))
def match_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.stats(_matching(spark, d)))


@query("match_sample", S.build([S.panel(), *_dist("synthetic"), f"draws AS (SELECT item_id, month, k, {S.u('match', 'item_id', 'month', 'k')} AS u FROM (SELECT DISTINCT item_id, month FROM dist) CROSS JOIN range(1, 11) r(k))"], "SELECT item_id, CAST(month AS BIGINT) AS month, k, round(value, 6) AS value FROM draws JOIN dist USING (item_id, month) WHERE u >= cum_lo AND u < cum_hi"))
def match_sample(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.sample(_matching(spark, d), 10))


@query("match_sample_distinct")
def match_sample_distinct(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.sample_distinct(_matching(spark, d), 2, ordered=True))


_SLOTS = "slots AS (SELECT DISTINCT item_id, n AS n0, base_id, w FROM panel WHERE base_id = 2), grid AS (SELECT s.item_id, s.base_id, CAST(g.t AS INT) AS t, CAST(DATE '1999-01-01' + to_months(CAST(g.t - 1 AS INT)) AS DATE) AS date, (g.t - 1) % 12 + 1 AS month FROM slots s CROSS JOIN range(1, 35) g(t))"


@query("resample_synthetic", S.build([S.panel(), *_dist("synthetic"), _SLOTS, f"draws AS (SELECT *, {S.u('synth', 'rep', 't', 'item_id')} AS u FROM grid CROSS JOIN range(1, {SMALL + 1}) r(rep))"], "SELECT rep, CAST(base_id AS BIGINT) AS base_id, CAST(t AS BIGINT) AS t, CAST(t AS BIGINT) AS t_global, date, item_id, round(value, 6) AS v FROM draws JOIN dist USING (item_id, month) WHERE u >= cum_lo AND u < cum_hi"))
def resample_synthetic(spark: SparkSession, d: str) -> DataFrame:
    return _long(R.Synthetic(G.packed(_matching(spark, d), 1)).sample(sales_panel(spark, d).slice(first=TWO_BASES[1].start_date), SMALL))


@query("synthetic_population", S.build([S.panel(), *_dist("synthetic"), _SLOTS], "SELECT CAST(base_id AS BIGINT) AS base_id, CAST(t AS BIGINT) AS t, CAST(t AS BIGINT) AS t_global, date, item_id, round(e, 6) AS v FROM grid JOIN (SELECT item_id, month, sum(value * weight) AS e FROM dist GROUP BY ALL) USING (item_id, month)"))
def synthetic_population(spark: SparkSession, d: str) -> DataFrame:
    return _long(R.Synthetic(G.packed(_matching(spark, d), 1)).population(sales_panel(spark, d).slice(first=TWO_BASES[1].start_date)))


# trends ------------------------------------------------------------------------------------------------------------

SINE, EXPONENTIAL = D.AnalyticTrend(D.sine), D.ExponentialTrend(0.03)
_SINE = "(1 + sin(2 * pi() * t_global / 12))"
_EXP = f"pow({(1 + 0.03) ** (1 / 12)!r}, t_global)"
TABLE = D.TableTrend([1 + 0.001 * k * (-1) ** k for k in range(70)])
_TABLE = "(1 + 0.001 * (t_global - 1) * (CASE WHEN (t_global - 1) % 2 = 0 THEN 1 ELSE -1 END))"


@query("trend_offsets", S.build([S.panel(THREE_BASES)], "SELECT CAST(base_id AS BIGINT) AS base_id, CAST(min(t_global) AS BIGINT) AS first, CAST(max(t_global) AS BIGINT) AS last FROM panel GROUP BY base_id"))
def trend_offsets(spark: SparkSession, d: str) -> DataFrame:
    months = sales_panel(spark, d, THREE_BASES).changes()
    return rounded(D.offsets_of(months.groupBy("base_id").agg(F.col("base_id").alias("ord"), F.max("t").alias("n_periods"))))


def _factor_query(name: str, trend: D.Trend, sql: str) -> None:
    """The factors of the months that the panel has."""

    def of_months(spark: SparkSession, d: str) -> DataFrame:
        p = sales_panel(spark, d)
        return rounded(p.changes().select("t_global").distinct().join(trend.factors(spark, p.periods), "t_global"))

    query(name, S.build([S.panel()], f"SELECT CAST(t_global AS BIGINT) AS t_global, round({sql}, 6) AS factor FROM (SELECT DISTINCT t_global FROM panel)"))(of_months)


_factor_query("trend_analytic", SINE, _SINE)
_factor_query("trend_exponential", EXPONENTIAL, _EXP)
_factor_query("trend_table_rw", TABLE, _TABLE)
_factor_query("trend_identity", D.IdentityTrend(), "1.0::DOUBLE")
_panel_query("trend_apply", SINE.apply, [S.trended("tr", "panel", _SINE)], f"SELECT {CELLS} FROM tr", THREE_BASES)
_panel_query("trend_apply_identity", D.IdentityTrend().apply, [], f"SELECT {CELLS} FROM panel")

_CALIBRATED = """level AS (SELECT t_global, sum(ln(1 + m / 100)) OVER (ORDER BY t_global) AS l FROM (SELECT t_global, sum(w * v) / sum(w) AS m FROM panel GROUP BY t_global)),
calibrated AS (SELECT t_global, l - (SELECT max_by(l, t_global) / max(t_global) FROM level) * t_global AS y FROM level)"""


@query("trend_calibrated", S.build([S.panel(), _CALIBRATED, S.trended("tr", "(SELECT * FROM panel JOIN calibrated USING (t_global))", "exp(y)")], f"SELECT {CELLS} FROM tr"))
def trend_calibrated(spark: SparkSession, d: str) -> DataFrame:
    """Two calibrations are written, from the panel's own price level; the latest is read back and imposed."""
    p, folder = sales_panel(spark, d), f"{store.working_folder(spark)}/trends-{uuid.uuid4().hex}"
    y = D.log_level(p)
    D.write_calibrated(y.withColumn("y", F.col("y") + 1), folder, dt.date(2000, 12, 31))
    D.write_calibrated(y, folder, dt.date(2001, 10, 31))
    return _long(D.read_calibrated(spark, folder).apply(p))


_AR = "pairs AS (SELECT y, lag(y) OVER (ORDER BY t_global) AS b FROM calibrated), ar AS (SELECT phi, sqrt((yy - 2 * phi * yb + phi * phi * bb) / (n - 1)) AS sigma FROM (SELECT sum(y * b) / sum(b * b) AS phi, sum(y * y) AS yy, sum(y * b) AS yb, sum(b * b) AS bb, count(*) AS n FROM pairs WHERE b IS NOT NULL))"
_PATHS = f"shock AS (SELECT fold, candidate, t, sigma * {S.normal('drw', 'fold', 'candidate', 't')} AS e FROM range(1, 4) f(fold) CROSS JOIN range(1, 65) c(candidate) CROSS JOIN range(1, 61) g(t), ar), path AS (SELECT s.fold, s.candidate, s.t, sum(pow(phi, s.t - x.t) * x.e) AS y FROM shock s JOIN shock x ON x.fold = s.fold AND x.candidate = s.candidate AND x.t <= s.t, ar GROUP BY ALL)"


_FITTED = [S.panel(), _CALIBRATED, _AR, _PATHS]


def _fit(spark: SparkSession, d: str) -> tuple[float, float]:
    """The persistence and the spread of the panel's own price level."""
    return D.autoregression(D.log_level(sales_panel(spark, d)))


def _months_of(paths: DataFrame) -> DataFrame:
    found = paths.select("fold", "candidate", F.posexplode("factors").alias("t", "factor"))
    return rounded(found.select("fold", "candidate", (F.col("t") + 1).alias("t"), "factor"), 5)


@query("trend_dynamic", S.build(_FITTED, "SELECT fold, candidate, t, round(exp(y), 5) AS factor FROM path WHERE candidate <= 4"))
def trend_dynamic(spark: SparkSession, d: str) -> DataFrame:
    paths = D.candidates(spark, [1, 2, 3], range(1, 5), 60, *_fit(spark, d))
    return _months_of(paths.withColumn("factors", F.transform("y", F.exp)))


@query("trend_zeromean_filter", S.build([*_FITTED, "ok AS (SELECT fold, min(candidate) AS candidate FROM (SELECT fold, candidate FROM path GROUP BY ALL HAVING abs(avg(y)) <= 0.1) GROUP BY fold)"], "SELECT p.fold, p.candidate, p.t, round(exp(p.y), 5) AS factor FROM path p JOIN ok USING (fold, candidate)"))
def trend_zeromean_filter(spark: SparkSession, d: str) -> DataFrame:
    """Paths of three folds, all in one plan."""
    return _months_of(D.generated(spark, 3, 60, *_fit(spark, d), most_blocks=2))


# measures ----------------------------------------------------------------------------------------------------------

_RATES = "SELECT CAST(t_global AS BIGINT) AS t_global, date, round(infl, 6) AS infl FROM traj"
MEASURES: dict[str, tuple[Measure, str]] = {
    "total": (TotalIndex(), S.index("panel")),
    "rebase": (RebasedIndex(12), S.index("panel", "(t - 1) // 12")),
    "rebase_limited": (RebasedIndex(9, 2), S.index("panel", "least((t - 1) // 9, 2)")),
    "weighted_mean": (WeightedMean(), S.weighted_mean("panel")),
    "percentile_eq": (PercentileEq(70), S.percentile("panel", 0.7)),
    "percentile_weighted": (PercentileWeighted(70), S.percentile_weighted("panel", 0.7)),
    "percentile_eq_spread": (PercentileEq(70, spread=True), S.percentile("panel", 0.7)),
    "percentile_weighted_spread": (PercentileWeighted(70, spread=True), S.percentile_weighted("panel", 0.7)),
}
for _name, (_measure, _sql) in MEASURES.items():
    query(f"infl_{_name}", S.build([S.panel(), S.yearly("traj", _sql)], _RATES))(lambda spark, d, m=_measure: rounded(m.apply(sales_panel(spark, d))))

ENSEMBLE = Ensemble((WeightedMean(), PercentileEq(70)))


@query("infl_ensemble", S.build([S.panel(), S.yearly("a", S.weighted_mean("panel")), S.yearly("b", S.percentile("panel", 0.7))], "SELECT CAST(t_global AS BIGINT) AS t_global, date, round(infl, 6) AS infl, 'WeightedMean' AS measure_id FROM a UNION ALL SELECT CAST(t_global AS BIGINT), date, round(infl, 6), 'PercEq-70' FROM b"))
def infl_ensemble(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ENSEMBLE.apply(sales_panel(spark, d)))


_SPREAD = (0, 10, 50, 70, 99.5, 100)
_LINES = "l AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_extendedprice AS v, l_quantity AS w FROM lineitem)"
_SPREAD_EQ = f"SELECT month, {', '.join(f'round(quantile_cont(v, {q / 100}), 6) AS p{i}' for i, q in enumerate(_SPREAD))} FROM l GROUP BY month"
_SPREAD_W = f"SELECT month, {', '.join(f'round(min(CASE WHEN c >= {q / 100!r} * total - 1e-12 THEN v END), 6) AS w{i}' for i, q in enumerate(_SPREAD))} FROM (SELECT month, v, sum(w) OVER (PARTITION BY month ORDER BY v) AS c, sum(w) OVER (PARTITION BY month) AS total FROM l) GROUP BY month"


@query("percentiles_spread", f"WITH {_LINES} SELECT * FROM ({_SPREAD_EQ}) JOIN ({_SPREAD_W}) USING (month)")
def percentiles_spread(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of all lines of a month, plain and weighted by quantity, by counts in buckets."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.trunc("l_shipdate", "month").alias("month"), F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("w"))
    both = percentiles_of(lines, ["month"], "v", _SPREAD, {"plain": None, "weighted": "w"}).filter("month is not null")
    return rounded(both.select("month", *[F.get(c, F.lit(i)).alias(f"{k}{i}") for c, k in (("plain", "p"), ("weighted", "w")) for i in range(len(_SPREAD))]))


JOINT = Ensemble(tuple(m for m, _ in MEASURES.values() if m.joint))


@query("infl_together", S.build([S.panel(), S.scramble("sample", SMALL), *[S.yearly(f"m{i}", sql("sample", ["rep"]), ["rep"]) for i, sql in enumerate(S.MEASURES)]], " UNION ALL ".join(f"SELECT CAST(rep AS BIGINT) AS rep, CAST(t_global AS BIGINT) AS t_global, date, round(infl, 6) AS infl, '{m.tag}' AS measure_id FROM m{i}" for i, m in enumerate(JOINT.parts))))
def infl_together(spark: SparkSession, d: str) -> DataFrame:
    """Six measures of the same replicates from one pass over them."""
    return rounded(JOINT.apply(SVM.sample(sales_panel(spark, d), SMALL)))


# parameters and trajectories ---------------------------------------------------------------------------------------

_POP = [S.population("pop0"), S.trended("pop", "pop0", _EXP)]
PARAMETERS: dict[str, tuple[Parameter, str]] = {
    "weighted_mean": (weighted_mean(SVM, EXPONENTIAL), S.weighted_mean("pop")),
    "total": (total(SVM, EXPONENTIAL), S.index("pop")),
    "total_rebase": (total_rebase(SVM, EXPONENTIAL), S.index("pop", "(t - 1) // 60")),
    "total_legacy_rebase": (total_legacy_rebase(SVM, EXPONENTIAL), S.index("pop", "least((t - 1) // 36, 2)")),
}
for _name, (_parameter, _sql) in PARAMETERS.items():
    query(f"param_{_name}", S.build([S.panel(), *_POP, S.yearly("traj", _sql)], _RATES))(lambda spark, d, p=_parameter: rounded(p.trajectory(sales_panel(spark, d))))

# the simulation that the queries below evaluate: weighted mean of scrambled months with an exponential trend
_TRAJ = [S.panel(), SVM_SQL, S.trended("tsample", "sample", _EXP, "rep,"), S.yearly("traj", S.weighted_mean("tsample", ["rep"]), ["rep"])]
_PARAM = [*_POP, S.yearly("param", S.weighted_mean("pop"))]
_ERRORS = [*_TRAJ, *_PARAM, S.errors("err")]
PARAMETER = PARAMETERS["weighted_mean"][0]


def _traj(spark: SparkSession, d: str, measure: Measure = WeightedMean(), reps: int = REPS) -> DataFrame:
    return trajectories(measure, SVM, EXPONENTIAL, sales_panel(spark, d), reps)


def _err(spark: SparkSession, d: str) -> DataFrame:
    return M.errors(_traj(spark, d), PARAMETER.trajectory(sales_panel(spark, d)))


@query("trajectories", S.build(_TRAJ, "SELECT CAST(rep AS BIGINT) AS rep, CAST(t_global AS BIGINT) AS t_global, date, round(infl, 6) AS infl FROM traj"))
def trajectories_(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_traj(spark, d).select("rep", "t_global", "date", "infl"))


# periods -----------------------------------------------------------------------------------------------------------


@query("period_single", S.build([S.panel(), S.yearly("traj", S.weighted_mean("panel"))], _RATES + " WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-01'"))
def period_single(spark: SparkSession, d: str) -> DataFrame:
    return rounded(WeightedMean().apply(sales_panel(spark, d)).filter(P1.mask()))


_MULTI = "(date BETWEEN DATE '1997-01-01' AND DATE '1997-12-01' OR date BETWEEN DATE '2000-06-01' AND DATE '2001-05-01')"


@query("period_vector", S.build([S.panel(), S.yearly("traj", S.weighted_mean("panel"))], _RATES + f" WHERE {_MULTI}"))
def period_vector(spark: SparkSession, d: str) -> DataFrame:
    return rounded(WeightedMean().apply(sales_panel(spark, d)).filter(MULTI.mask()))


# metrics -----------------------------------------------------------------------------------------------------------


@query("metrics_short", S.build([*_ERRORS, S.per_rep("r", "err")], f"SELECT {S.picked(S.short_metrics())} FROM r"))
def metrics_short(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.evaluate(_err(spark, d)))


def _doubles(df: DataFrame, but: Sequence[str] = ()) -> DataFrame:
    return rounded(df.select(*[F.col(c) if c in but else F.col(c).cast("double").alias(c) for c in df.columns]))


@query("metrics_full", S.build([*_ERRORS, S.per_rep("r", "err")], f"SELECT {S.picked(S.full_metrics('err'))} FROM r"))
def metrics_full(spark: SparkSession, d: str) -> DataFrame:
    return _doubles(M.evaluate(_err(spark, d), short=False))


_TAGGED = f"terr AS (SELECT '' AS tag, * FROM err UNION ALL SELECT 'p1', * FROM err WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-01' UNION ALL SELECT 'p2', * FROM err WHERE date BETWEEN DATE '1999-01-01' AND DATE '2001-10-01' UNION ALL SELECT 'multi', * FROM err WHERE {_MULTI})"
PERIODS = (CompletePeriod(), P1, P2, MULTI)


@query("metrics_by_period", S.build([*_ERRORS, _TAGGED, S.per_rep("r", "terr", ["tag"])], f"SELECT tag, {S.picked(S.short_metrics())} FROM r GROUP BY tag"))
def metrics_by_period(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.evaluate(tagged(_err(spark, d), PERIODS), ["tag"]))


@query("metrics_batched", S.build([*_ERRORS, S.per_rep("r0", "err"), f"r AS (SELECT *, CAST(ceil(rep / 5.0) AS INT) AS batch FROM r0), each AS (SELECT batch, {', '.join(f'{v} AS {k}' for k, v in S.short_metrics().items())} FROM r GROUP BY batch)"], f"SELECT {S.picked({k: f'avg({k})' for k in S.short_metrics()})} FROM each"))
def metrics_batched(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.evaluate_batched(_err(spark, d), REPS, 4))


_TWO = [S.panel(), SVM_SQL, S.trended("tsample", "sample", _EXP, "rep,"), S.yearly("a", S.weighted_mean("tsample", ["rep"]), ["rep"]), S.yearly("b", S.percentile("tsample", 0.7, ["rep"]), ["rep"]), *_PARAM]
NAMES = ("WeightedMean", "PercEq-70")


@query("metrics_combination", S.build([*_TWO, "traj AS (SELECT rep, t_global, date, 0.6 * a.infl + 0.4 * b.infl AS infl FROM a JOIN b USING (rep, t_global, date))", S.errors("err"), S.per_rep("r", "err")], f"SELECT {S.picked(S.short_metrics())} FROM r"))
def metrics_combination(spark: SparkSession, d: str) -> DataFrame:
    mixed = M.combined(_traj(spark, d, ENSEMBLE), C.as_table(spark, NAMES, (0.6, 0.4)))
    return rounded(M.evaluate(M.errors(mixed, PARAMETER.trajectory(sales_panel(spark, d)))))


def _config(nsim: int = REPS) -> SimConfig:
    return SimConfig(WeightedMean(), SVM, EXPONENTIAL, PARAMETER, nsim, dt.date(2001, 10, 1), PERIODS)


for _metric in ("mse", "absme", "corr"):
    query(f"online_{_metric}", S.build([*_ERRORS, S.per_rep("r", "err")], f"SELECT {S.picked({_metric: S.short_metrics()[_metric]})} FROM r"))(
        lambda spark, d, m=_metric: rounded(online(m, _config(), sales_panel(spark, d), REPS))
    )


@query("lowlevel_static", ORACLE_SQL["metrics_by_period"])
def lowlevel_static(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lowlevel(sales_panel(spark, d), _config(), short=True)[0])


@query("assessment_static")
def assessment_static(spark: SparkSession, d: str) -> DataFrame:
    return assessment(sales_panel(spark, d), _config(), short=False)


SWEEP = tuple(range(50, 81))
_SWEEP = f"SELECT rep, unnest([{', '.join(map(str, SWEEP))}]) AS q, t_global, date, unnest(quantile_cont(v, [{', '.join(str(q / 100) for q in SWEEP)}])) AS m FROM tsample GROUP BY rep, t_global, date"


@query("assessment_sweep", S.build([S.panel(), SVM_SQL, S.trended("tsample", "sample", _EXP, "rep,"), S.yearly("traj", _SWEEP, ["rep", "q"]), *_PARAM, S.errors("err"), _TAGGED, S.per_rep("r", "terr", ["tag", "q"])], f"SELECT 'PercEq-' || q AS measure_tag, tag, {S.picked(S.short_metrics())} FROM r GROUP BY tag, q"))
def assessment_sweep(spark: SparkSession, d: str) -> DataFrame:
    """A configuration for each percentile from 50 to 80: one set of replicates, one pass over them."""
    configs = [replace(_config(), measure=PercentileEq(q)) for q in SWEEP]
    found = evaluate_batch(sales_panel(spark, d), configs)
    return rounded(found.select("measure_tag", "tag", *M.SHORT))


_RESUMED = (50, 60, 70, 80)


@query("store_resumed", S.build([S.panel(), SVM_SQL, S.trended("tsample", "sample", _EXP, "rep,"), S.yearly("traj", f"SELECT rep, unnest([{', '.join(map(str, _RESUMED))}]) AS q, t_global, date, unnest(quantile_cont(v, [{', '.join(str(q / 100) for q in _RESUMED)}])) AS m FROM tsample GROUP BY rep, t_global, date", ["rep", "q"]), *_PARAM, S.errors("err"), S.per_rep("r", "err", ["q"])], f"SELECT 'PercEq-' || q AS measure_tag, {S.picked(S.short_metrics())}, CAST(sum(n) AS BIGINT) AS cells FROM r GROUP BY q"))
def store_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Two configurations are stored, then four are asked for: the two that lack are added; all are collected."""
    kept = store.Store(spark, f"{store.working_folder(spark)}/results-{uuid.uuid4().hex}")
    p, configs = sales_panel(spark, d), [replace(_config(), measure=PercentileEq(q), evalperiods=(CompletePeriod(),)) for q in _RESUMED]
    first, then = (assessment_store(p, c, kept) for c in (configs[:2], configs))
    if len(first) != 2 or len(then) != 2:
        raise RuntimeError("the store did not resume")
    cells = kept.read("trajectories").groupBy("config_key").agg(F.count("*").alias("cells"))
    return rounded(kept.read("metrics").join(cells, "config_key").select("measure_tag", *M.SHORT, "cells"))


# folds -------------------------------------------------------------------------------------------------------------

FOLDS = [[1 + 0.002 * t * f for t in range(1, 71)] for f in (1, 2, 3)]
DYNAMIC = SimDynamicConfig(WeightedMean(), SVM, FOLDS, PARAMETER, SMALL, dt.date(2001, 10, 1))
_FOLD = "(1 + 0.002 * t_global * fold)"
_FOLD_DRAW = S.scramble("sample", SMALL, source="fpanel", seed=f"({DEFAULT_SEED} + fold + 3)", extra="d.fold")
_DYNAMIC = [
    S.panel(),
    "folds AS (SELECT CAST(fold AS INT) AS fold FROM range(1, 4) f(fold)), fpanel AS (SELECT * FROM panel CROSS JOIN folds)",
    _FOLD_DRAW,
    S.trended("tsample", "sample", _FOLD, "rep, fold,"),
    S.yearly("traj", S.weighted_mean("tsample", ["fold", "rep"]), ["fold", "rep"]),
    S.population("pop0"),
    "fpop AS (SELECT * FROM pop0 CROSS JOIN folds)",
    S.trended("pop", "fpop", _FOLD, "fold,"),
    S.yearly("param", S.weighted_mean("pop", ["fold"]), ["fold"]),
    S.errors("err", on="fold, t_global"),
    S.per_rep("r", "err", ["fold"]),
    f"byfold AS (SELECT fold, {', '.join(f'{v} AS {k}' for k, v in S.short_metrics().items())} FROM r GROUP BY fold)",
]


@query("metrics_by_fold", S.build(_DYNAMIC, f"SELECT CAST(fold AS BIGINT) AS fold, {S.picked({k: k for k in S.short_metrics()})} FROM byfold"))
def metrics_by_fold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lowlevel_dynamic(sales_panel(spark, d), DYNAMIC, short=True)[0])


@query("fold_metrics_merge", S.build(_DYNAMIC, "SELECT metric, string_agg(printf('%.4f', value), ' ' ORDER BY fold) AS vals FROM (UNPIVOT byfold ON mse, rmse, mae, me, absme, huber, corr INTO NAME metric VALUE value) GROUP BY metric"))
def fold_metrics_merge(spark: SparkSession, d: str) -> DataFrame:
    by = assessment_dynamic(sales_panel(spark, d), DYNAMIC, short=True).by_metric
    return by.select("metric", F.concat_ws(" ", F.transform("values", lambda v: F.format_string("%.4f", v))).alias("vals"))


@query("fold_summary", S.build(_DYNAMIC, "SELECT metric, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(*)), 6) AS std_error FROM (UNPIVOT (SELECT fold, rmse, me, corr FROM byfold) ON rmse, me, corr INTO NAME metric VALUE value) GROUP BY metric"))
def fold_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(assessment_dynamic(sales_panel(spark, d), DYNAMIC, short=True).summary)


@query("fold_trajectories", S.build(_DYNAMIC, f"SELECT CAST(fold AS BIGINT) AS fold, CAST((fold - 1) * {SMALL} + rep AS BIGINT) AS rep_global, CAST(t_global AS BIGINT) AS t_global, round(infl, 6) AS infl FROM traj"))
def fold_trajectories(spark: SparkSession, d: str) -> DataFrame:
    return rounded(assessment_dynamic(sales_panel(spark, d), DYNAMIC, short=True).trajectories.select("fold", "rep_global", "t_global", "infl"))


# configurations and the store --------------------------------------------------------------------------------------

@query("config_keys", S.build([S.panel(THREE_BASES)], "SELECT measure || ', SVM, EXP3%, WeightedMean, ' || (CASE WHEN nsim >= 1000 THEN (nsim // 1000) || 'k' ELSE nsim || '' END) || ', ' || strftime(last, '%b%y') AS name FROM (SELECT base_id, CASE WHEN base_id = 3 THEN 'WeightedMean' ELSE 'PercEq-' || (50 + 10 * base_id) END AS measure, count(*) AS nsim, max(date) AS last FROM panel GROUP BY base_id)"))
def config_keys(spark: SparkSession, d: str) -> DataFrame:
    """The names of a configuration for each base: as many replicates as it has changes, trained up to its end."""
    bases = sales_panel(spark, d, THREE_BASES).changes().groupBy("base_id").agg(F.count("*").alias("nsim"), F.max("date").alias("last")).collect()
    configs = [SimConfig(WeightedMean() if r["base_id"] == 3 else PercentileEq(50 + 10 * r["base_id"]), SVM, EXPONENTIAL, PARAMETER, r["nsim"], r["last"]) for r in bases]
    if len({c.key() for c in configs}) != len(configs):
        raise RuntimeError("keys of different configurations are equal")
    return spark.createDataFrame([(c.savename(suffix=""),) for c in configs], "name string")


@query("pending_configs", "SELECT DISTINCT p_type AS config_key FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_size > 45)")
def pending_configs(spark: SparkSession, d: str) -> DataFrame:
    """The types of parts that are asked for but have no large part, as a store of those with one would tell."""
    parts = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_type").alias("config_key"), "p_size")
    return store.pending(parts.select("config_key").distinct(), parts.filter("p_size > 45"))


@query("latest_calibration", "SELECT 'RWTREND ' || strftime(max(o_orderdate), '%Y-%m-%d') || '.parquet' AS path, CAST(max(o_orderdate) AS DATE) AS date FROM orders WHERE o_orderpriority = '1-URGENT'")
def latest_calibration(spark: SparkSession, d: str) -> DataFrame:
    """The latest of files that are named by the days of orders; those of other priorities are no calibrations."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    prefix = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("RWTREND ")).otherwise(F.lit("other "))
    return D.latest_file(orders.select(F.concat(prefix, F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".parquet")).alias("path")))


# combinations ------------------------------------------------------------------------------------------------------

_GRAM = [*_TWO, "g AS (SELECT a.rep, avg(a.infl * a.infl) AS xx00, avg(a.infl * b.infl) AS xx01, avg(b.infl * b.infl) AS xx11, avg(a.infl * p.infl) AS xp0, avg(b.infl * p.infl) AS xp1, avg(p.infl * p.infl) AS pp, avg(a.infl) AS mx0, avg(b.infl) AS mx1, avg(p.infl) AS mp FROM a JOIN b USING (rep, t_global) JOIN param p USING (t_global) GROUP BY a.rep), m AS (SELECT avg(xx00) AS a, avg(xx01) AS b, avg(xx11) AS c, avg(xp0) AS p, avg(xp1) AS q, avg(pp) AS pp, avg(mx0) - avg(mp) AS e0, avg(mx1) - avg(mp) AS e1 FROM g)"]


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return C.moment_rows(_traj(spark, d, ENSEMBLE), PARAMETER.trajectory(sales_panel(spark, d)), NAMES)


def _weights(spark: SparkSession, w: Sequence[float]) -> DataFrame:
    return rounded(C.as_table(spark, NAMES, w), 4)


def _weights_sql(first: str, second: str) -> str:
    return S.build(_GRAM, f"SELECT 'WeightedMean' AS measure_id, round({first}, 4) AS w FROM m UNION ALL SELECT 'PercEq-70', round({second}, 4) FROM m")


@query("weights_moments", S.build(_GRAM, "SELECT i, j, round(value, 5) AS value FROM m, LATERAL (VALUES (0, 0, a), (0, 1, b), (1, 1, c), (0, -1, p), (1, -1, q)) x(i, j, value)").replace("SELECT i, j,", "SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j,"))
def weights_moments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.average_moments(_rows(spark, d)), 5)


@query("weights_ls", _weights_sql("(p * c - b * q) / (a * c - b * b)", "(a * q - b * p) / (a * c - b * b)"))
def weights_ls(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, C.least_squares(C.moments(_rows(spark, d), NAMES)))


@query("weights_ridge", _weights_sql("(p * (c + 0.5) - b * q) / ((a + 0.5) * (c + 0.5) - b * b)", "((a + 0.5) * q - b * p) / ((a + 0.5) * (c + 0.5) - b * b)"))
def weights_ridge(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, C.ridge(C.moments(_rows(spark, d), NAMES), 0.5))


#: Gradient steps are kept within what the scale of the moments allows.
STEP, LAM, GAMMA = 1e-5, 0.1, 0.3


def _descent(mse: str, l1: float, l2: float) -> str:
    cost = f"({mse} * (x * x * a + 2 * x * y * b + y * y * c - 2 * x * p - 2 * y * q + pp) + {l1} * (abs(x) + abs(y)) + {0.5 * l2} * (x * x + y * y))"
    t = STEP * l1
    soft = lambda z: f"({z} - greatest(-{t!r}, least({t!r}, {z})))"
    nx, ny = soft(f"(x - {STEP!r} * (a * x + b * y - p + {l2!r} * x))"), soft(f"(y - {STEP!r} * (b * x + c * y - q + {l2!r} * y))")
    sql = S.build(
        [*_GRAM, f"steps AS (SELECT 1 AS i, {nx} AS x, {ny} AS y, CAST(NULL AS DOUBLE) AS was, {nx} AS lx FROM m, (SELECT 0.0::DOUBLE AS x, 0.0::DOUBLE AS y) UNION ALL SELECT i + 1, {nx}, {ny}, {cost}, x FROM steps, m WHERE i < 1000 AND (was IS NULL OR abs({cost} - was) >= 1e-4)), last AS (SELECT x, y FROM steps ORDER BY i DESC LIMIT 1)"],
        "SELECT 'WeightedMean' AS measure_id, round(x, 4) AS w FROM last UNION ALL SELECT 'PercEq-70', round(y, 4) FROM last",
    )
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("weights_lasso", _descent("1.0", LAM, 0.0))
def weights_lasso(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, C.lasso(C.moments(_rows(spark, d), NAMES), LAM, step=STEP))


@query("weights_elastic", _descent("0.5", LAM * GAMMA, LAM * (1 - GAMMA)))
def weights_elastic(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, C.elastic_net(C.moments(_rows(spark, d), NAMES), LAM, GAMMA, step=STEP))


_SHARE = "greatest(0.0, least(1.0, (p - q - b + c) / (a - 2 * b + c)))"


@query("weights_share_qp", _weights_sql(_SHARE, f"1 - {_SHARE}"))
def weights_share_qp(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, C.share_weights(C.moments(_rows(spark, d), NAMES)))


@query("weights_absme_objective", S.build(_GRAM, "SELECT round(CASE WHEN least(e0, e1) <= 0 AND greatest(e0, e1) >= 0 THEN 0.0 ELSE least(abs(e0), abs(e1)) END, 6) AS objective FROM m"))
def weights_absme_objective(spark: SparkSession, d: str) -> DataFrame:
    m = C.moments(_rows(spark, d), NAMES)
    value = abs(float((m.mx.mean(axis=0) - m.mp.mean()) @ C.absme_weights(m)))
    return rounded(spark.createDataFrame([(value,)], "objective double")).select((F.col("objective") + 0.0).alias("objective"))


def _search(name: str, find: Callable[[C.Moments], np.ndarray]) -> None:
    query(name)(lambda spark, d: C.as_table(spark, NAMES, find(C.moments(_rows(spark, d), NAMES))))


_search("weights_share_rmse", lambda m: C.share_weights_rmse(m, 0.01)["weights"])
_search("weights_share_absme", lambda m: C.share_weights_absme(m, 0.01)["weights"])
_search("weights_share_corr", lambda m: C.share_weights_corr(m)["weights"])
_search("weights_metric_nm", lambda m: C.metric_weights(m, "rmse"))

_W1, _W2 = "round(1.2 - 10 * l_discount, 2)", "round(10 * l_tax - 0.2, 2)"


@query("weights_penalty", f"SELECT w1, w2, round(CASE WHEN w1 < 0 THEN 2 - 2 * w1 ELSE 0 END + CASE WHEN w2 < 0 THEN 2 - 2 * w2 ELSE 0 END + CASE WHEN abs(w1 + w2 - 1) >= 0.01 THEN 5 + 2 * abs(w1 + w2 - 1) ELSE 0 END, 6) AS penalty FROM (SELECT DISTINCT {_W1} AS w1, {_W2} AS w2 FROM lineitem)")
def weights_penalty(spark: SparkSession, d: str) -> DataFrame:
    """The penalty of each pair of weights that the lines' discounts and taxes give."""
    pairs = spark.read.parquet(f"{d}/lineitem.parquet").select(F.expr(_W1).alias("w1"), F.expr(_W2).alias("w2")).distinct()
    return rounded(pairs.withColumn("penalty", C.penalty_of(F.array("w1", "w2"))))


# three measures and more: what the searches find against a grid of weights
TRIO = Ensemble((WeightedMean(), PercentileEq(70), PercentileWeighted(60)))
TRIO_NAMES = tuple(m.tag for m in TRIO.parts)
_TRIO = [S.panel(), SVM_SQL, S.trended("tsample", "sample", _EXP, "rep,"), S.yearly("a", S.weighted_mean("tsample", ["rep"]), ["rep"]), S.yearly("b", S.percentile("tsample", 0.7, ["rep"]), ["rep"]), S.yearly("c", S.percentile_weighted("tsample", 0.6, ["rep"]), ["rep"]), *_PARAM]
_WIDE = "wide AS (SELECT a.rep, a.t_global, a.date, a.infl AS x, b.infl AS y, c.infl AS z, p.infl AS pi FROM a JOIN b USING (rep, t_global) JOIN c USING (rep, t_global) JOIN param p USING (t_global))"


def grid(parts: int, edge: bool = True) -> np.ndarray:
    """All weights of three measures in steps of 1 / parts, with or without those that have a 0."""
    first = 0 if edge else 1
    found = [(i, j, parts - i - j) for i in range(first, parts + 1) for j in range(first, parts + 1 - i) if parts - i - j >= first]
    return np.array(found) / parts


def _grid_sql(parts: int, edge: bool = True) -> str:
    first = 0 if edge else 1
    return f"grid AS (SELECT CAST(row_number() OVER (ORDER BY i, j) - 1 AS BIGINT) AS candidate, i / {parts} AS u, j / {parts} AS v, ({parts} - i - j) / {parts} AS w FROM range({first}, {parts + 1}) r(i), range({first}, {parts + 1}) s(j) WHERE {parts} - i - j >= {first})"


_EACH = "cand AS (SELECT candidate, u, v, w, rep, u * x + v * y + w * z AS infl, pi, u * x + v * y + w * z - pi AS e FROM wide CROSS JOIN grid)"


def _trio(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _traj(spark, d, TRIO), PARAMETER.trajectory(sales_panel(spark, d))


@query("weights_candidates", S.build([*_TRIO, _WIDE, _grid_sql(4), _EACH, S.per_rep("r", "cand", ["candidate"])], f"SELECT candidate, {S.picked(S.short_metrics())} FROM r GROUP BY candidate"))
def weights_candidates(spark: SparkSession, d: str) -> DataFrame:
    """All short metrics of a generation of weights, in one job."""
    return rounded(C.evaluate_candidates(*_trio(spark, d), TRIO_NAMES, grid(4)))


def _bound(spark: SparkSession, tried: np.ndarray, value: float) -> DataFrame:
    """The best of the grid, and whether the search is no worse."""
    low = float(np.min(tried))
    return rounded(spark.createDataFrame([(low, bool(value <= low + 1e-9))], "grid_objective double, no_worse boolean"), 5)


_LAM, _BATCHES, _FINE = 0.0001, 4, 20
_BARRIER = f"{_LAM!r} * (1 / (100 * u) + 1 / (100 * v) + 1 / (100 * w))"


def _bound_sql(edge: bool, objective: str, parts: int = _FINE) -> str:
    return S.build([*_TRIO, _WIDE, _grid_sql(parts, edge), _EACH, S.per_rep("r", "cand", ["candidate", "u", "v", "w"])], f"SELECT round(min(o), 5) AS grid_objective, true AS no_worse FROM ({objective})")


@query("weights_share_rmse_bound", _bound_sql(False, f"SELECT 10 * avg(rmse_k) + {_BARRIER} AS o FROM r GROUP BY candidate, u, v, w"))
def weights_share_rmse_bound(spark: SparkSession, d: str) -> DataFrame:
    m = C.moments(C.moment_rows(*_trio(spark, d), TRIO_NAMES), TRIO_NAMES)
    tried = [10 * C._metric(m, w, "rmse") + C._penalty(w, _LAM) for w in grid(_FINE, False)]
    return _bound(spark, tried, C.share_weights_rmse(m, _LAM, _BATCHES)["value"])


@query("weights_share_absme_bound", _bound_sql(False, f"SELECT 10 * avg(m) + {_BARRIER} AS o FROM (SELECT candidate, u, v, w, abs(avg(me_k)) AS m FROM r GROUP BY candidate, u, v, w, (rep - 1) // {REPS // _BATCHES}) GROUP BY candidate, u, v, w"))
def weights_share_absme_bound(spark: SparkSession, d: str) -> DataFrame:
    m = C.moments(C.moment_rows(*_trio(spark, d), TRIO_NAMES), TRIO_NAMES)
    mean_x, mean_p = m.mx.reshape(_BATCHES, -1, 3).mean(axis=1), m.mp.reshape(_BATCHES, -1).mean(axis=1)
    tried = [10 * np.abs(mean_x @ w - mean_p).mean() + C._penalty(w, _LAM) for w in grid(_FINE, False)]
    return _bound(spark, tried, C.share_weights_absme(m, _LAM, _BATCHES)["value"])


@query("weights_share_corr_bound", _bound_sql(True, "SELECT -avg(rho) AS o FROM r GROUP BY candidate"))
def weights_share_corr_bound(spark: SparkSession, d: str) -> DataFrame:
    m = C.moments(C.moment_rows(*_trio(spark, d), TRIO_NAMES), TRIO_NAMES)
    return _bound(spark, [-C.mean_corr(m, w) for w in grid(_FINE)], -C.share_weights_corr(m)["value"])


for _metric in ("mae", "huber"):

    @query(f"weights_{_metric}_bound", _bound_sql(True, f"SELECT {S.short_metrics()[_metric]} AS o FROM r GROUP BY candidate", 8))
    def _weights_bound(spark: SparkSession, d: str, metric: str = _metric) -> DataFrame:
        traj, population = _trio(spark, d)
        found = C.trajectory_weights(traj, population, TRIO_NAMES, metric)
        tried = C.evaluate_candidates(traj, population, TRIO_NAMES, grid(8)).agg(F.min(metric).alias("low"))
        return rounded(tried.select(F.col("low").alias("grid_objective"), (F.lit(found["value"]) <= F.col("low") + 1e-9).alias("no_worse")), 5)


@query("soft_threshold", S.build([S.panel()], "SELECT CAST(base_id AS BIGINT) AS base_id, CAST(t AS BIGINT) AS t, item_id, round(v - greatest(-2.0, least(2.0, v)), 6) AS z FROM panel"))
def soft_threshold_(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sales_panel(spark, d).changes().select("base_id", "t", "item_id", soft_threshold(F.col("v"), 2.0).alias("z")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All short metrics of a simulation by evaluation period."""
    return QUERIES["metrics_by_period"](spark, sf_dir)


def with_reps(reps: int) -> Query:
    """The full metrics of a simulation of ``reps`` replicates, for measurements."""
    config = replace(_config(), nsim=reps)
    return lambda spark, d: lowlevel(sales_panel(spark, d), config, short=False)[0]
