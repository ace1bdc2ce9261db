"""Pieces of SQL used by several equivalents: average ranks and tail probabilities."""

from __future__ import annotations


def average_rank(value: str, partition: str = "") -> str:
    over = f"PARTITION BY {partition}" if partition else ""
    same = f"PARTITION BY {partition + ', ' if partition else ''}{value}"
    return f"(rank() OVER ({over} ORDER BY {value}) + (count(*) OVER ({same}) - 1) / 2.0)"


def _beta_series(x: str, a: str, b: str) -> str:
    """I_x(a, b) by its positive series; accurate where x is at most a half."""
    term = (
        f"exp(lgamma({a} + {b} + k) - lgamma({a} + 1 + k) + lgamma({a} + 1) - lgamma({a} + {b}) + k * ln({x}))"
    )
    front = f"exp({a} * ln({x}) + {b} * ln(1 - {x}) + lgamma({a} + {b}) - lgamma({a} + 1) - lgamma({b}))"
    return f"({front} * list_sum(list_transform(range(0, 2500), lambda k: {term})))"


def t_pvalue(t: str, df: str) -> str:
    z = f"(({t}) * ({t}) / (({df}) + ({t}) * ({t})))"
    far = _beta_series(f"(1 - {z})", f"(({df}) / 2.0)", "0.5")
    near = f"(1 - {_beta_series(z, '0.5', f'(({df}) / 2.0)')})"
    return (
        f"CASE WHEN ({t}) IS NULL THEN NULL WHEN ({t}) = 0 THEN 1.0 WHEN {z} >= 1 THEN 0.0 "
        f"WHEN {z} > 0.5 THEN {far} ELSE {near} END"
    )


def correlation_pvalue(rho: str, n: str) -> str:
    t = f"(({rho}) * sqrt((({n}) - 2) / ((1 + ({rho})) * (1 - ({rho})))))"
    return (
        f"CASE WHEN ({rho}) IS NULL THEN NULL WHEN 1 - abs({rho}) < 1e-15 THEN 0.0 "
        f"ELSE ({t_pvalue(t, f'(({n}) - 2)')}) END"
    )


def z_pvalue(z: str) -> str:
    """erfc(|z| / sqrt 2) through the positive series of erf."""
    x = f"(abs({z}) / sqrt(2.0))"
    erf = f"list_sum(list_transform(range(0, 300), lambda k: exp(-{x} * {x} + (2 * k + 1) * ln({x}) - lgamma(k + 1.5))))"
    return f"CASE WHEN ({z}) IS NULL THEN NULL WHEN {x} = 0 THEN 1.0 WHEN {x} > 6 THEN 0.0 ELSE 1 - {erf} END"


def spearman_groups(source: str, keys: str, min_obs: int, name: str = "ics") -> str:
    """CTEs giving n_obs, ic, status per group of ``source(keys, x, y)``; keys are non-empty."""
    on = " AND ".join(f"g.{k.strip()} IS NOT DISTINCT FROM m.{k.strip()}" for k in keys.split(","))
    cols = ", ".join(f"g.{k.strip()}" for k in keys.split(","))
    return f"""{name}_ranked AS (
  SELECT {keys}, {average_rank("x", keys)} - (count(*) OVER (PARTITION BY {keys}) + 1) / 2.0 AS rx,
         {average_rank("y", keys)} - (count(*) OVER (PARTITION BY {keys}) + 1) / 2.0 AS ry
  FROM {source} WHERE x IS NOT NULL AND y IS NOT NULL),
{name}_moments AS (
  SELECT {keys}, sum(rx * ry) / nullif(sqrt(sum(rx * rx)) * sqrt(sum(ry * ry)), 0) AS rho,
         min(rx) = max(rx) OR min(ry) = max(ry) AS flat FROM {name}_ranked GROUP BY {keys}),
{name}_groups AS (SELECT {keys}, count(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 1 END) AS n_obs FROM {source} GROUP BY {keys}),
{name} AS (
  SELECT {cols}, g.n_obs, CASE WHEN g.n_obs >= {min_obs} AND NOT m.flat THEN m.rho END AS ic,
         CASE WHEN g.n_obs < {min_obs} THEN 'too_few_obs' WHEN m.flat THEN 'constant_input' ELSE 'ok' END AS status
  FROM {name}_groups g LEFT JOIN {name}_moments m ON {on})"""


def pairs(table: str, by: list[str], signals: list[str], outcomes: list[str]) -> str:
    """Rows (by, signal, outcome, x, y), one per signal, outcome and row of ``table``."""
    head = "".join(f"{b}, " for b in by)
    return " UNION ALL ".join(
        f"SELECT {head}'{s}' AS signal, '{o}' AS outcome, CAST({s} AS DOUBLE) AS x, CAST({o} AS DOUBLE) AS y FROM {table}"
        for s in signals
        for o in outcomes
    )


def quantile_label(value: str, tie: str, partition: str, bins: str = "5") -> str:
    over = f"PARTITION BY {partition} " if partition else ""
    r = f"(row_number() OVER ({over}ORDER BY {value}, {tie}) - 1)"
    n = f"count(*) OVER ({over.strip()})"
    return f"CAST(greatest(1, ({r} * {bins} + greatest({n} - 1, 1) - 1) // greatest({n} - 1, 1)) AS INTEGER)"
