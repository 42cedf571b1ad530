import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from driftloom.functions.counter import normal, uniform
from driftloom.operators import combine as C
from driftloom.operators import matching as G
from driftloom.operators import metrics as M
from driftloom.operators import resample as R
from driftloom.operators import trend as D
from driftloom.operators.measures import PercentileEq, TotalIndex, WeightedMean
from driftloom.operators.periods import B10, CompletePeriod, EvalPeriod, PeriodVector, eval_periods
from driftloom.plans import config as K
from driftloom.plans.parameter import Parameter, total, weighted_mean
from driftloom.plans.simulate import assessment_batch, assessment_dynamic, lowlevel, lowlevel_dynamic, online, trajectories
from driftloom.sources import store
from driftloom.sources.panel import Base, from_changes

START = dt.date(2001, 1, 1)


def panel(spark, lengths=(24, 24), items=3, value=lambda b, t, i: 0.0):
    bases, rows, weights, start = [], [], [], START
    for b, n in enumerate(lengths, 1):
        bases.append(Base(b, start, n))
        start = dt.date(start.year + (start.month - 1 + n) // 12, (start.month - 1 + n) % 12 + 1, 1)
        for i in range(items):
            weights.append((b, f"i{i}", 1.0 / items))
            rows += [(b, t, f"i{i}", float(value(b, t, i))) for t in range(1, n + 1)]
    return from_changes(spark.createDataFrame(rows, "base_id int, t int, item_id string, v double"), spark.createDataFrame(weights, "base_id int, item_id string, w double"), bases)


def unique(b, t, i):
    return 10000 * b + 1000 * i + t


def values(p):
    return {(r.base_id, r.t, r.item_id): r.v for r in p.changes().collect()}


def test_panel_slices_and_dates(spark):
    p = panel(spark, value=unique).slice(last=dt.date(2003, 6, 1))
    assert p.periods == 30 and p.infl_periods == 19 and p.infl_dates[0] == dt.date(2001, 12, 1)
    rows = p.changes().orderBy("t_global").collect()
    assert rows[0].date == START and rows[-1].date == dt.date(2003, 6, 1)
    with pytest.raises(ValueError):
        p.slice(first=dt.date(2030, 1, 1))


@pytest.mark.parametrize("trend", [D.IdentityTrend(), D.AnalyticTrend(D.sine), D.ExponentialTrend(), D.TableTrend([1.5] * 48)])
def test_trends_leave_a_zero_panel(spark, trend):
    assert set(values(trend.apply(panel(spark))).values()) == {0.0}
    assert all(-1e-12 < r.factor < 3 for r in trend.factors(spark, 48).collect())


def test_trend_raises_only_rises_and_follows_bases(spark):
    p = D.TableTrend([float(k) for k in range(1, 58)]).apply(panel(spark, (24, 18, 15), 2, lambda b, t, i: -1 if b == 1 else 1))
    got = values(p)
    assert got[1, 5, "i0"] == -1 and got[2, 1, "i0"] == 25 and got[3, 15, "i1"] == 57
    with pytest.raises(ValueError):
        D.ExponentialTrend(2.0)


def test_draws_stay_in_item_and_calendar_month(spark):
    p = panel(spark, (24, 30), value=unique)
    got = R.ScrambleByMonth().sample(p, 4).changes().collect()
    assert len(got) == 4 * 54 * 3
    for r in got:
        base, item, t = r.v // 10000, (r.v % 10000) // 1000, r.v % 1000
        assert base == r.base_id and f"i{int(item)}" == r.item_id and (t - r.t) % 12 == 0


def test_draws_do_not_depend_on_partitions(spark):
    p = panel(spark, value=unique)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = []
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append(sorted((r.rep, r.base_id, r.t, r.item_id, r.v) for r in R.ScrambleByMonth().sample(p, 6).changes().collect()))
        assert out[0] == out[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_population_is_the_mean_of_draws(spark):
    p = panel(spark, (24,), 2, lambda b, t, i: t + i)
    for r in (R.ScrambleByMonth(), R.WeightedScramble(0.7)):
        drawn = r.sample(p, 400).changes().groupBy("t", "item_id").agg(F.avg("v").alias("m"))
        pop = r.population(p).changes()
        off = drawn.join(pop, ["t", "item_id"]).select(F.max(F.abs(F.col("m") - F.col("v")))).first()[0]
        assert off < 1.5


def test_weighted_scramble_limits(spark):
    p = panel(spark, (24,), value=unique)
    assert values(R.WeightedScramble(1.0).sample(p, 1)) == values(p)
    one = panel(spark, (12,), value=unique)  # one observation a stripe
    assert values(R.WeightedScramble(0.3).sample(one, 1)) == values(one) == values(R.WeightedScramble(0.3).population(one))
    with pytest.raises(ValueError):
        R.WeightedScramble(1.5)
    with pytest.raises(ValueError):
        R.WeightedScrambleByBase((0.5,)).sample(panel(spark), 1)


def test_extension_and_mixture(spark):
    p = panel(spark, (24, 18, 15), value=unique)
    long = R.ExtendedScramble((30, 20, 12)).sample(p, 2)
    assert [b.n_periods for b in long.bases] == [30, 20, 12] and long.bases[2].start_date == dt.date(2005, 3, 1)
    assert R.ExtendedScramble([40]).population(p).periods == 120
    with pytest.raises(ValueError):
        R.ExtendedScramble((30, 20)).sample(p, 1)
    with pytest.raises(ValueError):
        R.ExtendedScramble(30).sample(panel(spark, (9,)), 1)
    mixed = R.Mixture((R.Identity(), R.ExtendedScramble(30), R.WeightedScrambleByBase((0, 0, 0.5))))
    got = mixed.sample(p, 2)
    assert [b.n_periods for b in got.bases] == [24, 30, 15]
    first = {k: v for k, v in values(p).items() if k[0] == 1}
    assert {(r.base_id, r.t, r.item_id): r.v for r in got.changes().filter("base_id = 1 and rep = 2").collect()} == first
    with pytest.raises(ValueError):
        R.Mixture((R.Identity(),)).sample(p, 1)
    assert values(R.Mixture([R.Identity()] * 3).population(p)) == values(p)


def observed(spark):
    rows = [("x", 1, v, False) for v in (1.0, 2.0, 2.0)] + [("x", 1, v, True) for v in (2.0, 3.0)]
    return spark.createDataFrame(rows, "item_id string, month int, value double, is_actual boolean")


def test_matched_distributions(spark):
    obs = observed(spark)
    prior = G.build(obs, G.prior_weights).orderBy("idx").collect()
    assert [r.value for r in prior if r.weight > 0] == [1.0, 2.0, 2.0, 2.0]  # a value counts, not its origin
    actual = G.build(obs, G.actual_weights)
    assert {r.value for r in G.sample(actual, 200).collect()} <= {2.0, 3.0}
    d = G.build(obs)
    w = np.array([r.weight for r in d.orderBy("idx").collect()])
    v = np.array([1.0, 2.0, 2.0, 2.0, 3.0])
    s = G.stats(d).first()
    assert abs(w.sum() - 1) < 1e-12 and abs(s.mean - v @ w) < 1e-9
    assert abs(s["std"] - np.sqrt(5 / 4 * (w * (v - v @ w) ** 2).sum())) < 1e-9
    assert G.sample(d, 50).count() == 50 and G.sample_distinct(d, 3).count() == 3 and "n = 5" in G.describe(d).first().label
    with pytest.raises(ValueError):
        G.build(obs.withColumn("month", F.lit(13)))


def test_synthetic(spark):
    p = panel(spark, (24,), 2, lambda b, t, i: t + i)
    dist = G.packed(G.build(G.observations(p, p)), 1)
    r = R.Synthetic(dist, 60)
    got = r.sample(p, 2)
    assert got.periods == 60 and got.changes().count() == 240
    expected = {(x.item_id, x.slot): x.expected for x in dist.collect()}
    assert all(abs(x.v - expected[x.item_id, (x.t - 1) % 12 + 1]) < 1e-9 for x in r.population(p).changes().collect())
    for bad in (panel(spark, (24, 24), 2), panel(spark, (24,), 3), p.slice(first=dt.date(2001, 3, 1))):
        with pytest.raises(ValueError):
            R.Synthetic(dist).sample(bad, 1)
    with pytest.raises(ValueError):
        R.Synthetic(dist, 0).sample(p, 1)


def test_generated_trends(spark):
    y = D.candidates(spark, [1], [1], 4000, 0.7, 0.5).first().y
    y = np.array(y)
    assert abs(np.corrcoef(y[1:], y[:-1])[0, 1] - 0.7) < 0.05 and abs(y.var() - 0.25 / (1 - 0.49)) < 0.1
    a, b = (D.generated(spark, 2, length=36).collect() for _ in range(2))
    assert a == b and all(abs(np.mean(r.y)) <= 0.1 and np.allclose(r.factors, np.exp(r.y)) for r in a)
    assert all(r.y[-1] < -0.2 for r in D.generated(spark, 2, length=24, accept=lambda v: F.element_at(v, -1) < -0.2).collect())
    with pytest.raises(RuntimeError):
        D.generated(spark, 1, length=12, accept=lambda v: F.lit(False), block=2, most_blocks=2)


def test_random_numbers(spark):
    r = spark.range(20000).select(uniform(1, "a", "id").alias("u"), normal(1, "a", "id").alias("z")).agg(F.avg("u"), F.min("u"), F.max("u"), F.avg("z"), F.stddev("z")).first()
    assert abs(r[0] - 0.5) < 0.01 and 0 <= r[1] and r[2] < 1 and abs(r[3]) < 0.03 and abs(r[4] - 1) < 0.03


def test_periods(spark):
    t = WeightedMean().apply(panel(spark, (36,)))
    assert eval_periods(t, CompletePeriod()).count() == 25
    one = EvalPeriod(start=dt.date(2002, 1, 1), final=dt.date(2002, 6, 1), tag="x")
    assert eval_periods(t, one).count() == 6 and list(one) == [one] and B10.tag == "b10"
    two = PeriodVector(parts=((dt.date(2002, 1, 1), dt.date(2002, 6, 1)), (dt.date(2002, 5, 1), dt.date(2002, 7, 1))))
    assert eval_periods(t, two).count() == 7


def test_measures(spark):
    p = panel(spark, (24, 24), 3, lambda b, t, i: 1.0)
    want = 100 * (1.01**12 - 1)
    for m in (TotalIndex(), WeightedMean(), PercentileEq(50)):
        got = m.apply(p).orderBy("t_global").collect()
        assert len(got) == 37 and all(abs(r.infl - want) < 1e-8 for r in got)


def cube(spark, cells):
    rows = [(k, t, float(x), 0.0, float(x)) for k, row in enumerate(cells, 1) for t, x in enumerate(row, 1)]
    return spark.createDataFrame(rows, "rep int, t_global int, infl double, pi double, e double")


def test_metrics(spark):
    m = M.evaluate(cube(spark, [[1, -1], [3, 3]]), short=False).first()
    assert m.rmse == 2 and m.mse == 5 and m.me == 1.5 and m["T"] == 2 and m.B == 2 and m["corr"] != m["corr"]
    r = np.random.default_rng(0)
    x, p = r.normal(size=(5, 30)), r.normal(size=30)
    rows = [(k, t, float(x[k, t]), float(p[t]), float(x[k, t] - p[t])) for k in range(5) for t in range(30)]
    e = spark.createDataFrame(rows, "rep int, t_global int, infl double, pi double, e double")
    m = M.evaluate(e, short=False).first()
    assert abs(m.mse - m.mse_bias - m.mse_var - m.mse_cov) < 1e-9
    d = x - p
    assert abs(m.me_std_error - d.std(ddof=1) / 5**0.5) < 1e-9 and abs(m.std_sqerr_dist - (d**2).std(ddof=1)) < 1e-9
    assert abs(m["corr"] - np.mean([np.corrcoef(k, p)[0, 1] for k in x])) < 1e-9
    with pytest.raises(ValueError):
        M.evaluate_batched(e, 5, 2)
    assert M.prefixed({"mse": 1}, "p") == {"p_mse": 1} and M.long(M.evaluate(e)).count() == 7


def test_configs():
    param = Parameter(TotalIndex(), R.Identity(), D.IdentityTrend())
    c = K.SimConfig(WeightedMean(), R.ScrambleByMonth(), D.ExponentialTrend(), param, 1500, dt.date(2019, 12, 1))
    assert c.savename("mse") == "mse_WeightedMean, SVM, EXP2%, Total, 1k, Dec19.parquet"
    same_name = K.SimConfig(WeightedMean(), R.ScrambleByMonth(), D.ExponentialTrend(), param, 1600, dt.date(2019, 12, 1))
    assert c.savename() == same_name.savename() and c.key() != same_name.key()
    d = K.from_dict({"measure": TotalIndex(), "resampler": R.Identity(), "trends": [[1.0]] * 2, "parameter": param, "nsim": 10, "traindate": dt.date(2020, 12, 1)})
    assert d.nfolds == 2 and d.savename(suffix="") == "Total, IDTY, DynamicRW, Total, 2, 10, Dec20, CompletePeriod"
    with pytest.raises(ValueError, match="traindate"):
        K.from_dict({"measure": TotalIndex(), "resampler": R.Identity(), "trend": D.IdentityTrend(), "parameter": param, "nsim": 1})
    assert total().measure.tag == "Total" and weighted_mean().resampler.tag == "SVM"


def test_batch_and_online(spark, tmp_path):
    p = panel(spark, (24, 12), 3, lambda b, t, i: (t * 7 + i * 3 + b) % 5 - 1)
    param = Parameter(WeightedMean(), R.ScrambleByMonth(), D.IdentityTrend())
    configs = [K.SimConfig(WeightedMean(), R.ScrambleByMonth(), D.IdentityTrend(), param, n, dt.date(2003, 12, 1)) for n in (5, 6)]
    path = str(tmp_path / "results")
    assert len(assessment_batch(p, configs[:1], path)) == 1
    assert assessment_batch(p, configs, path) == [configs[1].key()]
    assert store.collect(spark, path).count() == 2 and assessment_batch(p, configs, path, recompute=True) == [c.key() for c in configs]
    offline, _ = lowlevel(p, configs[0], short=True)
    assert abs(online("mse", configs[0], p, 5).first().mse - offline.first().mse) < 1e-12
    with pytest.raises(ValueError):
        online("mae", configs[0], p)


def test_keys_differ_with_every_field(spark):
    from dataclasses import replace

    param = Parameter(TotalIndex(), R.Identity(), D.IdentityTrend())
    c = K.SimConfig(WeightedMean(), R.ScrambleByMonth(), D.ExponentialTrend(), param, 1500, dt.date(2019, 12, 1))
    others = [
        replace(c, measure=TotalIndex()), replace(c, trend=D.IdentityTrend()), replace(c, parameter=Parameter(WeightedMean(), R.Identity(), D.IdentityTrend())), replace(c, nsim=1501),
        replace(c, traindate=dt.date(2019, 12, 2)), replace(c, evalperiods=()), *[replace(c, resampler=R.WeightedScramble(q)) for q in (0.6, 0.9)],
        *[replace(c, resampler=R.ExtendedScramble(x)) for x in ((40, 50), ((90, 90)))],
    ]
    keys = [x.key() for x in [c, *others]] + [c.key(seed=3), c.key(short=False)]
    assert len(set(keys)) == len(keys) and c.key() == replace(c).key()


def test_batches_of_dynamic_configurations_keep_trajectories(spark, tmp_path):
    p = panel(spark, items=2)
    dynamic = K.SimDynamicConfig(TotalIndex(), R.Identity(), [[1.1] * 48, [1.2] * 48], Parameter(TotalIndex(), R.Identity()), 4, dt.date(2004, 12, 1))
    static = K.SimConfig(TotalIndex(), R.Identity(), D.IdentityTrend(), Parameter(TotalIndex(), R.Identity()), 4, dt.date(2004, 12, 1))
    path, kept = str(tmp_path / "results"), str(tmp_path / "trajectories")
    assert assessment_batch(p, [static, dynamic], path, trajectories_path=kept) == [static.key(), dynamic.key()]
    assert assessment_batch(p, [static, dynamic], path) == [] and assessment_batch(p, [static], path, seed=7) == [static.key(seed=7)]
    n = {r.config_key: r["count"] for r in store.collect(spark, kept).groupBy("config_key").count().collect()}
    assert n[dynamic.key()] == 2 * n[static.key()] > 0


def test_least_absolute_weights_are_optimal():
    r = np.random.default_rng(5)
    for n, batches in ((2, 1), (4, 3), (3, 8), (6, 2)):
        x, p_ = r.normal(0, 1, (batches, n)), r.normal(0, 0.3, batches)
        b = C._least_absolute(x, p_)
        tried = r.dirichlet(np.ones(n), 20_000)
        assert abs(b.sum() - 1) < 1e-9 and b.min() >= 0 and np.abs(x @ b - p_).sum() <= np.abs(tried @ x.T - p_).sum(axis=1).min() + 1e-9


def test_dynamic_on_a_zero_panel(spark):
    p = panel(spark, items=2)  # weights of a half keep all sums exact
    c = K.SimDynamicConfig(TotalIndex(), R.Identity(), [[1.1] * 48, [1.2] * 48], Parameter(TotalIndex(), R.Identity()), 10, dt.date(2004, 12, 1))
    r = assessment_dynamic(p, c)
    m = r.metrics.orderBy("fold").collect()
    assert [x.mse for x in m] == [0, 0] and all(x["corr"] != x["corr"] for x in m)
    assert r.trajectories.agg(F.count_distinct("rep_global")).first()[0] == 20 and r.population.count() == 2 * 37


def moments(seed=1, n=3, k=4, t=40, perfect=False):
    r = np.random.default_rng(seed)
    p = r.normal(3, 1, t)
    x = r.normal(3, 1, (k, t, n))
    if perfect:
        x[:, :, 0] = p
        x[:, :, 1] = p + 1
    xx = np.einsum("kti,ktj->kij", x, x) / t
    return C.Moments(tuple(map(str, range(n))), xx, np.einsum("kti,t->ki", x, p) / t, np.full(k, (p * p).mean()), x.mean(axis=1), np.full(k, p.mean())), x, p


def test_weights():
    m, x, p = moments(perfect=True, n=2)
    for w in (C.least_squares(m), C.share_weights(m), C.share_weights_rmse(m)["weights"], C.metric_weights(m, "mse", x_abstol=1e-4, f_abstol=1e-8)):
        assert np.allclose(w, [1, 0], atol=2e-2)
    m, x, p = moments()
    b = C.share_weights(m)
    xx, xp, pp = m.mean()
    cost = lambda w: w @ xx @ w - 2 * w @ xp + pp
    grid = [np.array([i, j, 20 - i - j]) / 20 for i in range(21) for j in range(21 - i)]
    assert abs(b.sum() - 1) < 1e-9 and b.min() >= 0 and cost(b) <= min(map(cost, grid)) + 1e-9
    rm = C.share_weights_rmse(m, 0.01)
    assert rm["value"] <= min(10 * C._metric(m, w, "rmse") + 0.01 * (1 / (100 * w)).sum() for w in grid if w.min() > 0) + 1e-6
    assert C.share_weights_absme(m)["absme"] <= min(abs(C._metric(m, w, "me")) for w in grid) + 1e-6
    assert C.share_weights_corr(m)["value"] >= max(C.mean_corr(m, w) for w in grid) - 1e-6
    w = np.array([0.2, 0.3, 0.5])
    assert abs(C._metric(m, w, "mse") - ((x @ w - p) ** 2).mean()) < 1e-9
    assert abs(C.mean_corr(m, w) - np.mean([np.corrcoef(k @ w, p)[0, 1] for k in x])) < 1e-9
    assert np.allclose(C.ridge(m, 0.0), C.least_squares(m)) and np.allclose(C.ridge(m, 1.0), np.linalg.solve(xx + np.eye(3), xp))
    assert C.constraint_penalty([0.5, 0.5]) == 0 and C.constraint_penalty([-0.5, 1.5]) == 3
    b, costs = C.elastic_net(m, 0.1, 0.5, step=1e-2, return_cost=True)
    assert len(costs) > 1 and (np.diff(costs) <= 1e-12).all()
    assert np.allclose(C.shrink(np.array([3.0, -0.5, 1.0]), 1.0), [2, 0, 0]) and C.shrink(np.array([3.0, 2.0]), 1.0, False)[0] == 3


def test_absme_weights():
    m, *_ = moments()
    for errors, want in (((-1.0, 2.0), 0.0), ((1.0, 2.0), 1.0)):
        k = C.Moments(("a", "b"), m.xx[:, :2, :2], m.xp[:, :2], m.pp, np.tile(np.array(errors), (4, 1)), np.zeros(4))
        w = C.absme_weights(k)
        assert abs(w.sum() - 1) < 1e-12 and w.min() >= 0 and abs(abs(np.array(errors) @ w) - want) < 1e-12


def test_combination_by_moments_equals_by_trajectories(spark):
    p = panel(spark, (36,), 4, lambda b, t, i: ((t * 13 + i * 7) % 11) - 4)
    from driftloom.operators.measures import Ensemble

    e = Ensemble((WeightedMean(), PercentileEq(70)))
    names = ("WeightedMean", "PercEq-70")
    traj = trajectories(e, R.ScrambleByMonth(), D.IdentityTrend(), p, 4)
    pop = Parameter(WeightedMean(), trend=D.IdentityTrend()).trajectory(p)
    m = C.moments(C.moment_rows(traj, pop, names), names)
    by = C.by_trajectories(traj, pop, names, "rmse")
    assert abs(by(np.array([0.3, 0.7])) - C._metric(m, np.array([0.3, 0.7]), "rmse")) < 1e-6


def test_streams_of_replicates(spark, tmp_path):
    from driftloom.streaming.online import accumulate, totals

    cells = cube(spark, [[1, -1], [3, 3], [2, 0]])
    cells.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    accumulate(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = totals(spark, str(tmp_path / "out")).first()
    want = M.evaluate(cells).first()
    assert abs(got.mse - want.mse) < 1e-12 and abs(got.absme - want.absme) < 1e-12


def test_ensembles_draw_their_replicates_once(spark):
    from driftloom.operators.measures import Ensemble, PercentileWeighted, RebasedIndex

    p = panel(spark, (30, 14), 5, lambda b, t, i: ((t * 13 + i * 7 + b) % 11) - 4)
    parts = (TotalIndex(), RebasedIndex(12), RebasedIndex(9, 1), WeightedMean(), PercentileEq(70), PercentileEq(30.5), PercentileWeighted(60), PercentileWeighted(100))
    sample = R.ScrambleByMonth().sample(p, 4)
    whole = Ensemble(parts).apply(sample)
    got = {(r.measure_id, r.rep, r.t_global): (r.date, r.infl) for r in whole.collect()}
    want = {(m.tag, r.rep, r.t_global): (r.date, r.infl) for m in parts for r in m.apply(sample).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("cartesian") == 0 and len(re.findall(r"md5\(", plan.split("== Initial Plan ==")[-1])) == len(re.findall(r"md5\(", sample.series._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]))
    assert {r.measure_id for r in Ensemble(parts[:2]).apply(p).collect()} == {"Total", "TotalRebase(12)"}


def test_batches_share_their_replicates(spark, tmp_path):
    from driftloom.operators.measures import Ensemble
    from driftloom.plans.simulate import _drawn, _groups, evaluate_batch

    p = panel(spark, (24, 24), 4, lambda b, t, i: ((t * 13 + i * 7 + b) % 11) - 4)
    param, other = (Parameter(m, R.ScrambleByMonth(), D.IdentityTrend()) for m in (WeightedMean(), TotalIndex()))
    last = dt.date(2004, 12, 1)
    half = EvalPeriod(start=dt.date(2002, 1, 1), final=dt.date(2003, 1, 1), tag="half")
    configs = [K.SimConfig(PercentileEq(q), R.ScrambleByMonth(), D.IdentityTrend(), param, 5 + q % 3, last, (CompletePeriod(), half) if q % 2 else (CompletePeriod(),)) for q in range(50, 81)]
    configs.append(K.SimConfig(TotalIndex(), R.ScrambleByMonth(), D.ExponentialTrend(), other, 4, last))
    configs.append(K.SimConfig(WeightedMean(), R.ScrambleByMonth(), D.IdentityTrend(), other, 9, last))
    configs.append(K.SimConfig(Ensemble((WeightedMean(), PercentileEq(70))), R.ScrambleByMonth(), D.IdentityTrend(), param, 6, last))
    configs += [K.SimDynamicConfig(m, R.ScrambleByMonth(), [[1.1] * 48, [1.2] * 48], param, n, last) for m, n in ((TotalIndex(), 3), (WeightedMean(), 4))]
    keyed = {c.key(): c for c in configs}
    groups = _groups(keyed)
    assert sorted(map(len, groups)) == [1, 2, 33]
    drawn = _drawn(p, max(groups, key=len), 1)
    dealt = re.findall(r"Exchange hashpartitioning\(rep", drawn._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1])
    assert len(dealt) == 1
    found = evaluate_batch(p, configs).collect()
    for c in configs[::7] + configs[-5:]:
        own = [r for r in found if r.config_key == c.key()]
        if isinstance(c, K.SimDynamicConfig):
            want = {(r.fold, None): r for r in lowlevel_dynamic(p, c, short=True)[0].collect()}
            got = {(r.fold, None): r for r in own}
        else:
            want = {(r.tag, r.asDict().get("measure_id")): r for r in lowlevel(p, c, short=True)[0].collect()}
            got = {(r.tag, r.measure_id): r for r in own}
        assert got.keys() == want.keys()
        assert all(abs(got[k][m] - want[k][m]) < 1e-9 for k in want for m in M.SHORT)
        assert {r.nsim for r in own} == {c.nsim} and {r.measure_tag for r in own} == {c.measure.tag}
    path, kept = str(tmp_path / "r"), str(tmp_path / "t")
    assert assessment_batch(p, configs, path, trajectories_path=kept) == list(keyed) and assessment_batch(p, configs, path) == []
    stored = {(r.config_key, r.tag, r.fold, r.measure_id): r.mse for r in store.collect(spark, path).collect()}
    assert stored.keys() == {(r.config_key, r.tag, r.fold, r.measure_id) for r in found}
    assert all(abs(stored[r.config_key, r.tag, r.fold, r.measure_id] - r.mse) < 1e-9 for r in found)
    assert {r.config_key: r.n for r in store.collect(spark, kept).groupBy("config_key").agg(F.count_distinct("rep").alias("n")).collect()} == {k: c.nsim for k, c in keyed.items()}


@pytest.mark.parametrize("n", [2, 3, 5, 8])
def test_shares_with_a_barrier_are_optimal(n):
    r = np.random.default_rng(n)
    for batches, lam in ((1, 0.0), (2, 1e-6), (3, 1e-4), (5, 0.01), (10, 1.0)):
        k, t = 10 * batches, 30
        p = r.normal(3, 1, t)
        x = p[None, :, None] + r.normal(r.normal(0, 0.4, n), r.uniform(0.1, 1, n), (k, t, n))
        m = C.Moments(tuple(map(str, range(n))), np.einsum("kti,ktj->kij", x, x) / t, np.einsum("kti,t->ki", x, p) / t, np.full(k, (p * p).mean()), x.mean(axis=1), np.full(k, p.mean()))
        mean_x, mean_p = m.mx.reshape(batches, -1, n).mean(axis=1), m.mp.reshape(batches, -1).mean(axis=1)
        rmse = lambda w: np.sqrt(np.maximum(np.einsum("ci,kij,cj->ck", w, m.xx, w, optimize=True) - 2 * w @ m.xp.T + m.pp, 0)).mean(axis=1)
        absme = lambda w: np.abs(w @ mean_x.T - mean_p).mean(axis=1)
        for found, metric in ((C.share_weights_rmse(m, lam, batches), rmse), (C.share_weights_absme(m, lam, batches), absme)):
            cost = lambda w: 10 * metric(w) + (lam * (1 / (100 * w)).sum(axis=1) if lam else 0)  # noqa: B023, E731
            b = found["weights"]
            assert abs(b.sum() - 1) < 1e-9 and b.min() >= 0 and abs(cost(b[None])[0] - found["value"]) < 1e-9
            best = b
            for spread in (None, 0.3, 0.1, 0.03, 0.01, 1e-3, 1e-4):  # random search, then around what is best
                tried = r.dirichlet(np.ones(n), 4000) if spread is None else np.abs(best + spread * r.normal(size=(4000, n)))
                tried = np.maximum(tried, 1e-12)
                tried /= tried.sum(axis=1, keepdims=True)
                values = cost(tried)
                assert found["value"] <= values.min() + 1e-6, (n, batches, lam, metric)
                best = tried[values.argmin()]


def test_norms_that_reach_zero():
    m, *_ = moments(perfect=True, n=2)
    assert np.allclose(C.share_weights_rmse(m)["weights"], [1, 0], atol=1e-4)
    one = C.Norms(np.ones(1), np.ones((1, 1, 1)), np.zeros((1, 1)), np.zeros(1))
    assert C.sum_of_norms(one).tolist() == [1.0]


def test_generations_of_weights(spark):
    from driftloom.operators.measures import Ensemble

    p = panel(spark, (40,), 4, lambda b, t, i: ((t * 13 + i * 7) % 11) - 4)
    e = Ensemble((WeightedMean(), PercentileEq(70), PercentileEq(40)))
    names = tuple(m.tag for m in e.parts)
    traj = trajectories(e, R.ScrambleByMonth(), D.IdentityTrend(), p, 4)
    pop = Parameter(WeightedMean(), trend=D.IdentityTrend()).trajectory(p)
    jobs = []
    objective = C.by_trajectories(traj.persist(), pop, names, "mae")

    def counted(w):
        jobs.append(len(w))
        return objective(w)

    b = C.searched_weights(counted, 3)
    assert len(jobs) <= 20 and abs(b.sum() - 1) < 1e-9 and b.min() >= 0
    grid = np.array([(i, j, 10 - i - j) for i in range(11) for j in range(11 - i)]) / 10
    assert objective(b) <= objective(grid).min() + 1e-6
    flat = lambda w: (np.atleast_2d(w)[:, 0] - 0.3) ** 2 + np.abs(np.atleast_2d(w)[:, 1] - 0.1)
    assert np.allclose(C.searched_weights(flat, 4, x_abstol=1e-5, most=60)[:2], [0.3, 0.1], atol=1e-3)
    cached = len(spark.sparkContext._jsc.getPersistentRDDs())
    assert C.trajectory_weights(traj, pop, names, "huber")["value"] <= C.by_trajectories(traj, pop, names, "huber")(grid).min() + 1e-6
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) <= cached
    m = C.moments(C.moment_rows(traj, pop, names), names)
    w = np.array([0.2, 0.5, 0.3])
    assert C.evaluate_combination(m, w) == -C.mean_corr(m, w)


def test_keys_tell_functions_apart():
    import functools

    def shifted(a):
        return lambda t: t + a

    def scaled(t, by=2):
        return t * by

    one, two = (lambda t: t + 1), (lambda t: t + 2)
    different = [one, two, shifted(1), shifted(2), functools.partial(scaled, by=3), functools.partial(scaled, by=4), scaled, D.sine]
    assert len({K.described(f) for f in different}) == len(different)
    assert K.described(shifted(1)) == K.described(shifted(1)) and K.described(functools.partial(scaled, by=3)) == K.described(functools.partial(scaled, by=3))
    param = Parameter(TotalIndex(), R.Identity(), D.IdentityTrend())
    keys = {K.SimConfig(TotalIndex(), R.Identity(), D.AnalyticTrend(f), param, 5, dt.date(2003, 1, 1)).key() for f in different}
    assert len(keys) == len(different)


def test_one_sided_observations_are_refused(spark):
    rows = [("a", 1, 1.0, False), ("a", 1, 2.0, True), ("b", 1, 1.0, False), ("b", 1, 3.0, True)]
    schema = "item_id string, month int, value double, is_actual boolean"
    assert G.build(spark.createDataFrame(rows, schema)).count() == 4
    with pytest.raises(ValueError, match="no actual observations of b in month 2"):
        G.build(spark.createDataFrame([*rows, ("b", 2, 1.0, False), ("c", 1, 1.0, True)], schema))
    with pytest.raises(ValueError, match="no prior observations of c in month 1"):
        G.build(spark.createDataFrame([*rows, ("c", 1, 1.0, True)], schema))
    assert G.build(spark.createDataFrame([], schema)).count() == 0


def test_percentiles_by_counts(spark):
    from driftloom.operators.selection import percentiles

    r = np.random.default_rng(3)
    groups = {"skewed": np.exp(6 * r.normal(size=30_000)), "ties": r.integers(0, 3, 5000).astype(float), "one": np.array([2.5]), "two": np.array([-1.0, 4.0]), "same": np.full(700, 7.0), "negative": -np.exp(r.normal(size=999)), None: r.normal(size=101)}
    data = [(g, float(v), float(w)) for g, vs in groups.items() for v, w in zip(vs, r.uniform(0, 1, len(vs)), strict=True)]
    schema = "g string, v double, w double"
    df = spark.createDataFrame([*data, ("ties", None, 1.0), ("empty", None, 2.0)], schema).repartition(5)
    qs = (0, 1, 33.3, 50, 70, 99.9, 100)
    got = {x.g: x.percentiles for x in percentiles(df, ["g"], "v", qs).collect()}
    assert got.pop("empty") == [None] * len(qs) and got.keys() == groups.keys()
    for g, vs in groups.items():
        assert np.allclose(got[g], np.percentile(vs, qs), rtol=1e-9, atol=1e-12), g
    got = {x.g: x.percentiles for x in percentiles(df, ["g"], "v", qs, "w").collect()}
    for g in groups:
        rows = sorted((v, w) for k, v, w in data if k == g)
        total, sums = sum(w for _, w in rows), np.cumsum([w for _, w in rows])
        want = [rows[min(int(np.searchsorted(sums, q / 100 * total - 1e-12)), len(rows) - 1)][0] for q in qs]
        assert got[g] == want, g
    assert percentiles(spark.createDataFrame([], schema), ["g"], "v", qs).count() == 0


def test_percentiles_of_a_million_items(spark):
    from driftloom.operators.selection import percentiles

    df = spark.range(0, 1_000_000, numPartitions=8).select(F.lit(1).alias("t"), F.exp(9 * F.randn(5)).alias("v"))
    found = percentiles(df, ["t"], "v", [70])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bSort\b|Window|SortMergeJoin|SortAggregate", plan)
    assert abs(found.first().percentiles[0] / df.agg(F.percentile("v", 0.7)).first()[0] - 1) < 1e-12


def test_plain_and_weighted_percentiles_take_the_same_passes(spark, tmp_path):
    from driftloom.operators.selection import percentiles, percentiles_of

    made = spark.range(0, 60_000, numPartitions=4).select(F.expr("id % 3").alias("g"), F.exp(3 * F.randn(7)).alias("v"), F.expr("cast(1 + id % 50 as double)").alias("w"))
    made.write.parquet(f"{tmp_path}/t")
    df, qs = spark.read.parquet(f"{tmp_path}/t"), (0, 10, 50, 70, 99.5, 100)
    both = percentiles_of(df, ["g"], "v", qs, {"plain": None, "by": "w"})
    plan = both._jdf.queryExecution().executedPlan().toString()
    # no pass of its own for the groups without a value
    assert "LeftAnti" not in plan
    got = {x.g: (x.plain, x.by) for x in both.collect()}
    one, two = ({x.g: x.percentiles for x in percentiles(df, ["g"], "v", qs, w).collect()} for w in (None, "w"))
    assert got == {g: (one[g], two[g]) for g in range(3)}
    for g, rows in made.toPandas().sort_values("v").groupby("g"):
        assert np.allclose(got[g][0], np.percentile(rows.v, qs), rtol=1e-12)
        sums = rows.w.cumsum().to_numpy()
        assert got[g][1] == [rows.v.to_numpy()[np.searchsorted(sums, q / 100 * sums[-1] - 1e-12)] for q in qs]


def test_guide_tables_pick_as_the_whole_distribution(spark):
    r = np.random.default_rng(4)
    rows = []
    for i, n in enumerate((1, 2, 7, 100, 3, 5)):
        w = r.uniform(0, 1, n) ** 6
        w[: n // 2] = 0 if i == 3 else w[: n // 2]
        cum = np.cumsum(w / w.sum())
        cum[-1] = 1.0
        rows.append((i, [float(k) for k in range(n)], cum.tolist()))
    us = [*r.uniform(0, 1, 300), 0.0, 0.5, 1 - 2**-33, *[float(np.nextafter(c, x)) for _, _, cum in rows for c in cum[:-1] for x in (0, 1)], *[c for _, _, cum in rows for c in cum[:-1]]]
    df = spark.createDataFrame(rows, "i int, v array<double>, cum array<double>").withColumn("guide", G.guide_of(F.col("cum")))
    assert all(len(x.guide) == len(x.v) + 1 for x in df.collect())
    got = df.withColumn("u", F.explode(F.array(*[F.lit(float(u)) for u in us]))).select("i", "u", G.picked(F.col("v"), F.col("cum"), F.col("guide"), F.col("u")).alias("x"))
    cums = {i: cum for i, _, cum in rows}
    for x in got.collect():
        assert x.x == sum(c <= x.u for c in cums[x.i]), x
    dist = spark.createDataFrame([("a", 1, 1, 1.0, 1.0, 0.0, 1.0, True)], "item_id string, month int, idx int, value double, weight double, cum_lo double, cum_hi double, is_actual boolean")
    plan = G.sample(dist, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and G.sample(dist, 5).count() == 5


def test_store_shows_whole_commits_only(spark, tmp_path, monkeypatch):
    from driftloom.plans import simulate

    kept = store.Store(spark, str(tmp_path / "s"))
    assert kept.present(["a"]) == set() and kept.vacuum() == []
    with pytest.raises(FileNotFoundError):
        kept.read("metrics")
    p = panel(spark, (24, 12), 3, lambda b, t, i: (t * 7 + i * 3 + b) % 5 - 1)
    param = Parameter(WeightedMean(), R.ScrambleByMonth(), D.IdentityTrend())
    configs = [K.SimConfig(m, R.ScrambleByMonth(), D.IdentityTrend(), param, 3, dt.date(2003, 12, 1)) for m in (WeightedMean(), TotalIndex())]
    whole, evaluated = DataFrameWriter.parquet, simulate._evaluated
    for broken in ("metrics", "manifest"):

        def cut_off(self, path, *a, **b):
            if broken in path:  # noqa: B023
                raise RuntimeError("the driver died")
            whole(self, path, *a, **b)

        monkeypatch.setattr(DataFrameWriter, "parquet", cut_off)
        with pytest.raises(RuntimeError, match="died"):
            simulate.assessment_store(p, configs[:1], kept)
        monkeypatch.setattr(DataFrameWriter, "parquet", whole)
        assert kept.present([configs[0].key()]) == set()
        with pytest.raises(FileNotFoundError):
            kept.read("trajectories")
    assert simulate.assessment_store(p, configs[:1], kept) == [configs[0].key()]
    assert len(kept.vacuum()) == 2 and kept.read("metrics").count() == 1
    assert simulate.assessment_store(p, configs, kept) == [configs[1].key()]
    before = {r.config_key: r.mse for r in kept.read("metrics").collect()}
    assert simulate.assessment_store(p, configs, kept, recompute=True) == [c.key() for c in configs]
    assert {r.config_key: r.mse for r in kept.read("metrics").collect()} == before and kept.read("metrics").count() == 2
    n = kept.read("trajectories").count()
    assert len(kept.vacuum()) == 2 and kept.read("trajectories").count() == n == 2 * 3 * 25 and simulate._evaluated is evaluated


def test_calibrated_trends(spark, tmp_path):
    folder = str(tmp_path / "trends")
    with pytest.raises(FileNotFoundError):
        D.read_calibrated(spark, folder)
    y = spark.createDataFrame([(t, 0.1 * t) for t in range(1, 6)], "t_global int, y double")
    D.write_calibrated(y, folder, dt.date(2020, 6, 30))
    D.write_calibrated(y.withColumn("y", -F.col("y")), folder, dt.date(2019, 12, 31))
    assert np.allclose(D.read_calibrated(spark, folder).values, np.exp(0.1 * np.arange(1, 6)))
    assert {r.date for r in D.calibrated(spark, folder).collect()} == {dt.date(2020, 6, 30)}
    path = np.zeros(4000)
    shocks = np.random.default_rng(1).normal(size=4000)
    for t in range(1, 4000):
        path[t] = 0.8 * path[t - 1] + 0.3 * shocks[t]
    phi, sigma = D.autoregression(spark.createDataFrame([(t, float(v)) for t, v in enumerate(path)], "t_global int, y double"))
    assert abs(phi - 0.8) < 0.03 and abs(sigma - 0.3) < 0.02
    late = D.generated(spark, 3, 12, accept=lambda y: F.element_at(y, 1) > 0.12, block=4, most_blocks=90).collect()  # one in a hundred or so
    assert [r.fold for r in late] == [1, 2, 3] and max(r.candidate for r in late) > 16 and all(r.y[0] > 0.12 for r in late)
