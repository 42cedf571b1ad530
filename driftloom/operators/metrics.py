"""Errors of trajectories against the population trajectory.

One plan of two stages gives all metrics: sums within each replicate, then over replicates. Both are partial
aggregations, so replicates are merged as they come and no cube of trajectories is kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import correlation, huber, or_nan

SHORT = ("mse", "rmse", "mae", "me", "absme", "huber", "corr")
FULL = (
    "mse", "mse_std_error", "std_mse_dist", "std_sqerr_dist", "rmse", "rmse_std_error", "mae", "mae_std_error", "me", "me_std_error", "absme",
    "absme_std_error", "huber", "huber_std_error", "corr", "mse_bias", "mse_var", "mse_cov", "T", "B",
)


def errors(trajectories: DataFrame, population: DataFrame, on: Sequence[str] = ("t_global",)) -> DataFrame:
    """Trajectories with the population's rate as ``pi`` and the error as ``e``; the population is short."""
    pi = population.select(*on, F.col("infl").alias("pi"))
    return trajectories.join(F.broadcast(pi), list(on)).withColumn("e", F.col("infl") - F.col("pi"))


def _within(e: DataFrame, keys: Sequence[str], rep: str) -> DataFrame:
    x, p, d = F.col("infl"), F.col("pi"), F.col("e")
    return e.groupBy(*keys, rep).agg(
        F.count("*").alias("n"),
        F.sum(d * d).alias("s2"),
        F.sum(F.abs(d)).alias("s_abs"),
        F.sum(d).alias("s1"),
        F.sum(huber(d)).alias("s_h"),
        F.sum(F.pow(d * d, F.lit(2))).alias("s4"),
        F.sum(F.pow(huber(d), F.lit(2))).alias("s_h2"),
        F.stddev_pop(x).alias("sd_x"),
        F.stddev_pop(p).alias("sd_p"),
        F.covar_pop(x, p).alias("cov"),
    )


def _cell_sd(squares: str, total: str, n: Column) -> Column:
    """Sample standard deviation over all cells from sums of squares and values."""
    spread = F.sum(squares) - F.sum(total) * F.sum(total) / n
    return or_nan(F.sqrt(F.greatest(F.try_divide(spread, F.nullif(n - 1, F.lit(0.0))), F.lit(0.0))))


def evaluate(e: DataFrame, keys: Sequence[str] = (), short: bool = True, rep: str = "rep") -> DataFrame:
    """One row of metrics for each value of ``keys``, of rows (keys, rep, infl, pi, e).

    rmse is the mean of the replicates' own; mae, me, absme and huber have errors from the spread of all cells."""
    mse_k = F.col("s2") / F.col("n")
    r = _within(e, keys, rep).withColumns({"mse_k": mse_k, "rmse_k": F.sqrt(mse_k), "me_k": F.col("s1") / F.col("n"), "rho": correlation(F.col("cov"), F.col("sd_x"), F.col("sd_p"))})
    n, k = F.sum("n").cast("double"), F.count("*").cast("double")
    found = {
        "mse": F.sum("s2") / n,
        "rmse": F.avg("rmse_k"),
        "mae": F.sum("s_abs") / n,
        "me": F.sum("s1") / n,
        "absme": F.abs(F.sum("s1") / n),
        "huber": F.sum("s_h") / n,
        "corr": F.avg("rho"),
    }
    if not short:
        found |= {
            "std_mse_dist": or_nan(F.stddev_samp("mse_k")),
            "mse_std_error": or_nan(F.stddev_samp("mse_k")) / F.sqrt(k),
            "std_sqerr_dist": _cell_sd("s4", "s2", n),
            "rmse_std_error": or_nan(F.stddev_samp("rmse_k")) / F.sqrt(k),
            "mae_std_error": _cell_sd("s2", "s_abs", n) / F.sqrt(k),
            "me_std_error": _cell_sd("s2", "s1", n) / F.sqrt(k),
            "absme_std_error": _cell_sd("s2", "s1", n) / F.sqrt(k),
            "huber_std_error": _cell_sd("s_h2", "s_h", n) / F.sqrt(n),
            "mse_bias": F.avg(F.col("me_k") * F.col("me_k")),
            "mse_var": F.avg(F.pow(F.col("sd_x") - F.col("sd_p"), F.lit(2))),
            "mse_cov": F.avg(2 * (1 - F.col("rho")) * F.col("sd_x") * F.col("sd_p")),
            "T": F.max("n"),
            "B": F.count("*"),
        }
    names = SHORT if short else FULL
    return r.groupBy(*keys).agg(*[found[m].alias(m) for m in names])


def evaluate_batched(e: DataFrame, reps: int, batches: int, keys: Sequence[str] = (), short: bool = True, rep: str = "rep") -> DataFrame:
    """Metrics of each batch of consecutive replicates, averaged over batches; ``e`` has each batch's own population."""
    if reps % batches:
        raise ValueError("the batches must divide the replicates")
    each = evaluate(e.withColumn("batch", F.ceil(F.col(rep) / (reps // batches)).cast("int")), [*keys, "batch"], short, rep)
    return each.groupBy(*keys).agg(*[F.avg(F.col(m).cast("double")).alias(m) for m in (SHORT if short else FULL)])


def combined(trajectories: DataFrame, weights: DataFrame, keys: Sequence[str] = ("rep", "t_global")) -> DataFrame:
    """(keys, infl): the weighted sum of the measures' rates; weights has measure_id and w."""
    return trajectories.join(F.broadcast(weights), "measure_id").groupBy(*keys).agg(F.sum(F.col("infl") * F.col("w")).alias("infl"))


def long(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, metric, value)."""
    names = [c for c in metrics.columns if c not in keys]
    return metrics.unpivot(list(keys), [F.col(c).cast("double").alias(c) for c in names], "metric", "value")


def prefixed(row: dict, prefix: str = "") -> dict:
    return {f"{prefix}_{k}" if prefix else k: v for k, v in row.items()}


def merged_folds(metrics: DataFrame, names: Sequence[str] = SHORT, fold: str = "fold") -> DataFrame:
    """(metric, values): each metric's values in the order of folds."""
    rows = long(metrics.select(fold, *names), [fold])
    return rows.groupBy("metric").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(fold).alias("f"), "value"))), lambda x: x["value"]).alias("values"))


def fold_summary(metrics: DataFrame, names: Sequence[str] = ("rmse", "me", "corr"), fold: str = "fold") -> DataFrame:
    """(metric, mean, std_error) over folds."""
    rows = long(metrics.select(fold, *names), [fold])
    return rows.groupBy("metric").agg(F.avg("value").alias("mean"), (or_nan(F.stddev_samp("value")) / F.sqrt(F.count("*").cast("double"))).alias("std_error"))
