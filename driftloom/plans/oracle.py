"""The registered queries' SQL twins, put together from common table expressions."""

from __future__ import annotations

from collections.abc import Sequence

from ..functions.counter import DEFAULT_SEED
from ..sources.panel import TWO_BASES, Base


def u(stream: str, *keys: str, seed: str | int = DEFAULT_SEED) -> str:
    return f"(CAST(CAST('0x' || substr(md5(concat_ws('|', {seed}, '{stream}', {', '.join(keys)})), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0)"


def normal(stream: str, *keys: str, seed: str | int = DEFAULT_SEED) -> str:
    def bits(s: str) -> str:
        return f"((CAST(CAST('0x' || substr(md5(concat_ws('|', {seed}, '{s}', {', '.join(keys)})), 1, 8) AS UBIGINT) AS DOUBLE) + 0.5) / 4294967296.0)"

    return f"(sqrt(-2.0 * ln({bits(stream + '1')})) * cos(2 * pi() * {bits(stream + '2')}))"


def panel(bases: Sequence[Base] = TWO_BASES) -> str:
    """base (base_id, skip, n), weights and panel (base_id, n, t, t_global, date, item_id, w, v)."""
    skips = [(b.base_id, (b.start_date.year - 1995) * 12 + b.start_date.month - 1, b.n_periods) for b in bases]
    values = ", ".join(map(str, skips))
    return f"""monthly AS (
  SELECT p_brand AS item_id, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS m, sum(l_extendedprice) AS amount, sum(l_quantity) AS quantity
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '2001-11-01' GROUP BY ALL
), prices AS (
  SELECT item_id, m, last_value(price IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY m) AS price
  FROM (SELECT i.item_id, g.m, amount / quantity AS price FROM (SELECT DISTINCT item_id FROM monthly) i CROSS JOIN range(0, 82) g(m) LEFT JOIN monthly o ON o.item_id = i.item_id AND o.m = g.m)
), moves AS (
  SELECT item_id, m, 100.0 * (price / lag(price) OVER (PARTITION BY item_id ORDER BY m) - 1) AS v FROM prices
), base AS (
  SELECT * FROM (VALUES {values}) b(base_id, skip, n)
), weights AS (
  SELECT base_id, item_id, amount / sum(amount) OVER (PARTITION BY base_id) AS w
  FROM (SELECT base_id, item_id, sum(amount) AS amount FROM monthly JOIN base ON m BETWEEN skip AND skip + n - 1 GROUP BY ALL)
), panel AS (
  SELECT base_id, n, CAST(m - skip + 1 AS INT) AS t, CAST(m - {skips[0][1] - 1} AS INT) AS t_global, CAST(DATE '1995-01-01' + to_months(CAST(m AS INT)) AS DATE) AS date, item_id, w, v
  FROM moves JOIN base ON m BETWEEN skip AND skip + n - 1 JOIN weights USING (base_id, item_id)
)"""


def extended(lengths: Sequence[int]) -> str:
    """target: the panel's grid with other lengths, dates following on from the first base."""
    values = ", ".join(f"({i + 1}, {n}, {sum(lengths[:i])})" for i, n in enumerate(lengths))
    return f"""target AS (
  SELECT p.base_id, p.n, CAST(g.t AS INT) AS t, CAST(x.before + g.t AS INT) AS t_global, CAST(DATE '1996-01-01' + to_months(CAST(x.before + g.t - 1 AS INT)) AS DATE) AS date, p.item_id, p.w
  FROM (SELECT DISTINCT base_id, n, item_id, w FROM panel) p JOIN (VALUES {values}) x(base_id, ext, before) USING (base_id) CROSS JOIN range(1, 1000) g(t) WHERE g.t <= x.ext
)"""


SIZE = "((n - 1 - (t - 1) % 12) // 12 + 1)"
OWN = "((t - 1) // 12)"


def scramble(name: str, reps: int, stream: str = "svm", source: str = "panel", seed: str | int = DEFAULT_SEED, extra: str = "", where: str = "true") -> str:
    """name: draws by calendar month, alike likely."""
    place = f"(t - 1) % 12 + 12 * CAST(floor({u(stream, 'rep', 'base_id', 't', 'item_id', seed=seed)} * {SIZE}) AS INT) + 1"
    return _gather(name, place, reps, source, extra, where)


def weighted(name: str, p: str, reps: int, stream: str = "rst", where: str = "true") -> str:
    """name: a month keeps its value with probability p."""
    draw = u(stream, "rep", "base_id", "t", "item_id")
    other = f"CAST(floor(({draw} - {p}) / (1 - {p}) * ({SIZE} - 1)) AS INT)"
    index = f"CASE WHEN {SIZE} = 1 OR {draw} < {p} THEN {OWN} ELSE {other} + CASE WHEN {other} >= {OWN} THEN 1 ELSE 0 END END"
    return _gather(name, f"(t - 1) % 12 + 12 * ({index}) + 1", reps, "panel", "", where)


def _gather(name: str, place: str, reps: int, source: str, extra: str, where: str) -> str:
    return f"""{name} AS (
  SELECT d.rep{extra and ', ' + extra}, d.base_id, d.t, d.t_global, d.date, d.item_id, d.w, s.v
  FROM (SELECT *, {place} AS place FROM {source} CROSS JOIN (SELECT CAST(rep AS INT) AS rep FROM range(1, {reps + 1}) r(rep)) WHERE {where}) d
  JOIN panel s ON s.base_id = d.base_id AND s.item_id = d.item_id AND s.t = d.place
)"""


def population(name: str = "pop") -> str:
    return f"{name} AS (SELECT base_id, t, t_global, date, item_id, w, avg(v) OVER (PARTITION BY base_id, item_id, (t - 1) % 12) AS v FROM panel)"


def trended(name: str, source: str, factor: str, keys: str = "") -> str:
    return f"{name} AS (SELECT {keys} base_id, t, t_global, date, item_id, w, CASE WHEN v > 0 AND NOT isnan(v) THEN v * {factor} ELSE v END AS v FROM {source})"


def _list(keys: Sequence[str]) -> str:
    return "".join(f"{k}, " for k in keys)


def yearly(name: str, monthly: str, keys: Sequence[str] = ()) -> str:
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    return f"""{name} AS (
  SELECT {_list(keys)}t_global, date, 100 * (product(1 + m / 100) OVER ({part}ORDER BY t_global ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) - 1) AS infl
  FROM ({monthly}) QUALIFY row_number() OVER ({part}ORDER BY t_global) >= 12
)"""


def weighted_mean(source: str, keys: Sequence[str] = ()) -> str:
    return f"SELECT {_list(keys)}t_global, date, sum(w * v) / sum(w) AS m FROM {source} GROUP BY ALL"


def percentile(source: str, q: float, keys: Sequence[str] = ()) -> str:
    return f"SELECT {_list(keys)}t_global, date, quantile_cont(v, {q}) AS m FROM {source} GROUP BY ALL"


def percentile_weighted(source: str, q: float, keys: Sequence[str] = ()) -> str:
    k = f"{_list(keys)}t_global, date"
    return f"""SELECT {k}, min(v) AS m FROM (
  SELECT {k}, v, sum(w) OVER (PARTITION BY {k} ORDER BY v, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c, sum(w) OVER (PARTITION BY {k}) AS total FROM {source}
) WHERE c >= {q} * total - 1e-12 GROUP BY ALL"""


def index(source: str, segment: str = "0", keys: Sequence[str] = ()) -> str:
    k = _list(keys)
    return f"""SELECT {k}t_global, date, 100 * (x / coalesce(lag(x) OVER (PARTITION BY {k}base_id, seg ORDER BY t), 100.0) - 1) AS m FROM (
  SELECT {k}base_id, seg, t, t_global, date, sum(w * i) / sum(w) AS x FROM (
    SELECT *, 100.0 * product(1 + v / 100) OVER (PARTITION BY {k}base_id, item_id, seg ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i
    FROM (SELECT *, {segment} AS seg FROM {source})
  ) GROUP BY ALL
)"""


#: The measures of ``infl_together``, as functions of a source and keys.
MEASURES = (
    lambda source, keys: index(source, "0", keys),
    lambda source, keys: index(source, "(t - 1) // 12", keys),
    lambda source, keys: index(source, "least((t - 1) // 9, 2)", keys),
    weighted_mean,
    lambda source, keys: percentile(source, 0.7, keys),
    lambda source, keys: percentile_weighted(source, 0.7, keys),
)


def errors(name: str, traj: str = "traj", param: str = "param", on: str = "t_global") -> str:
    return f"{name} AS (SELECT x.*, y.infl AS pi, x.infl - y.infl AS e FROM {traj} x JOIN (SELECT {on}, infl FROM {param}) y USING ({on}))"


HUBER = "CASE WHEN abs(e) <= 1 THEN e * e / 2 ELSE abs(e) - 0.5 END"


def per_rep(name: str, source: str, keys: Sequence[str] = ()) -> str:
    return f"""{name} AS (
  SELECT *, s2 / n AS mse_k, sqrt(s2 / n) AS rmse_k, s1 / n AS me_k, CASE WHEN sd_x * sd_p = 0 THEN CAST('NaN' AS DOUBLE) ELSE cov / (sd_x * sd_p) END AS rho FROM (
    SELECT {_list(keys)}rep, CAST(count(*) AS DOUBLE) AS n, sum(e * e) AS s2, sum(abs(e)) AS s_abs, sum(e) AS s1, sum({HUBER}) AS s_h, stddev_pop(infl) AS sd_x, stddev_pop(pi) AS sd_p, covar_pop(infl, pi) AS cov
    FROM {source} GROUP BY ALL)
)"""


def short_metrics() -> dict[str, str]:
    return {"mse": "sum(s2) / sum(n)", "rmse": "avg(rmse_k)", "mae": "sum(s_abs) / sum(n)", "me": "sum(s1) / sum(n)", "absme": "abs(sum(s1) / sum(n))", "huber": "sum(s_h) / sum(n)", "corr": "avg(rho)"}


def full_metrics(cells: str) -> dict[str, str]:
    """``cells``: a table of all cells' errors (column e), for the spreads over cells."""
    k = "sqrt(count(*))"
    return short_metrics() | {
        "std_mse_dist": "stddev_samp(mse_k)",
        "mse_std_error": f"stddev_samp(mse_k) / {k}",
        "std_sqerr_dist": f"(SELECT stddev_samp(e * e) FROM {cells})",
        "rmse_std_error": f"stddev_samp(rmse_k) / {k}",
        "mae_std_error": f"(SELECT stddev_samp(abs(e)) FROM {cells}) / {k}",
        "me_std_error": f"(SELECT stddev_samp(e) FROM {cells}) / {k}",
        "absme_std_error": f"(SELECT stddev_samp(e) FROM {cells}) / {k}",
        "huber_std_error": f"(SELECT stddev_samp({HUBER}) FROM {cells}) / sqrt(sum(n))",
        "mse_bias": "avg(me_k * me_k)",
        "mse_var": "avg(pow(sd_x - sd_p, 2))",
        "mse_cov": "avg(2 * (1 - rho) * sd_x * sd_p)",
        "T": "max(n)",
        "B": "count(*)",
    }


def picked(found: dict[str, str], digits: int = 6) -> str:
    return ", ".join(f"round(CAST({v} AS DOUBLE), {digits}) AS {k}" for k, v in found.items())


def build(parts: Sequence[str], final: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + final
