"""Cross-sectional and pooled regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigvane import constants as K
from sigvane.functions import permute
from sigvane.operators import all_numbers as numbers
from sigvane.operators import ic, ols
from sigvane.plans import bindings as B
from sigvane.plans import sql_text as S
from sigvane.plans.queries_panel import rounded, rounded_sql
from sigvane.plans.queries_signals import count
from sigvane.plans.registry import QUERIES, query

SIGNALS = K.CROSS_SECTION_SIGNALS
OUTCOMES = [K.PRIMARY_OUTCOME, *K.SECONDARY_OUTCOMES]


def _prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ols.prepare_cross_section(B.vintage(spark, sf_dir), B.EXCLUDED, ("full", "excluded"))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staged prepared table of both samples."""
    return B.staged(spark, sf_dir, "prepared", _prepare)


def _inverse(k: int) -> list[list[str]]:
    """Entries of the inverse of the symmetric matrix s00..s(k-1)(k-1), by cofactors."""

    def s(i: int, j: int) -> str:
        return f"s{min(i, j)}{max(i, j)}"

    if k == 1:
        return [["(1.0 / s00)"]]
    if k == 2:
        det = "(s00 * s11 - s01 * s01)"
        return [[f"(s11 / {det})", f"(-s01 / {det})"], [f"(-s01 / {det})", f"(s00 / {det})"]]

    def cofactor(i: int, j: int) -> str:
        r, c = [x for x in range(3) if x != i], [x for x in range(3) if x != j]
        sign = "" if (i + j) % 2 == 0 else "-"
        return f"{sign}({s(r[0], c[0])} * {s(r[1], c[1])} - {s(r[0], c[1])} * {s(r[1], c[0])})"

    det = f"({' + '.join(f'{s(0, j)} * ({cofactor(0, j)})' for j in range(3))})"
    return [[f"(({cofactor(j, i)}) / {det})" for j in range(3)] for i in range(3)]


def hc3_sql(name: str, source: str, keys: list[str], group: str | None, y: str, xs: list[str], min_rows: int = 0) -> str:
    """CTE ``name`` with n, coef, se, r2 of the first regressor per key; ``source`` has complete rows."""
    k = len(xs)
    ks = ", ".join(keys)
    within = f"PARTITION BY {ks}{', ' + group if group else ''}"
    centred = ", ".join(f"{x} - avg({x}) OVER ({within}) AS x{i}" for i, x in enumerate(xs))
    sums = ", ".join(f"sum(x{i} * x{j}) AS s{i}{j}" for i in range(k) for j in range(i, k))
    ys = ", ".join(f"sum(x{i} * yc) AS y{i}" for i in range(k))
    inverse = _inverse(k)
    inv = ", ".join(f"{inverse[i][j]} AS i{i}{j}" for i in range(k) for j in range(k))
    beta = ", ".join("(" + " + ".join(f"i{i}{j} * y{j}" for j in range(k)) + f") AS b{i}" for i in range(k))
    residual = "yc - " + " - ".join(f"b{i} * x{i}" for i in range(k))
    influence = " + ".join(f"i0{i} * x{i}" for i in range(k))
    leverage = "1.0 / m + " + " + ".join(f"i{i}{j} * x{i} * x{j}" for i in range(k) for j in range(k))
    on = " AND ".join(f"c.{x} IS NOT DISTINCT FROM b.{x}" for x in keys)
    return f"""{name}_c AS (
  SELECT {ks}, {centred}, {y} - avg({y}) OVER ({within}) AS yc, {y} - avg({y}) OVER (PARTITION BY {ks}) AS yt, count(*) OVER ({within}) AS m FROM {source}),
{name}_g AS (SELECT {ks}, count(*) AS n, sum(yt * yt) AS tss, {sums}, {ys} FROM {name}_c GROUP BY {ks} HAVING count(*) >= {min_rows}),
{name}_i AS (SELECT *, {inv} FROM {name}_g), {name}_b AS (SELECT *, {beta} FROM {name}_i),
{name}_e AS (SELECT {", ".join("c." + x for x in keys)}, c.m, {residual} AS e, {influence} AS a, {leverage} AS h
  FROM {name}_c c JOIN {name}_b b ON {on}),
{name}_v AS (SELECT {ks}, sum(e * e) AS rss, sum(CASE WHEN m > 1 THEN (a * e / (1 - h)) * (a * e / (1 - h)) ELSE 0 END) AS v FROM {name}_e GROUP BY {ks}),
{name} AS (SELECT {", ".join("b." + x for x in keys)}, b.n, b.b0 AS coef, sqrt(c.v) AS se, 1 - c.rss / b.tss AS r2
  FROM {name}_b b JOIN {name}_v c ON {on})"""


def _ranks_sql(signals: list[str], carry: list[str]) -> str:
    """CTE ``ranked``: x is the percentile rank of the signal within its sample."""
    cols = ", ".join(carry)
    union = " UNION ALL ".join(f"SELECT sample, '{s}' AS signal, CAST({s} AS DOUBLE) AS value, {cols} FROM base" for s in signals)
    return f"""signal_rows AS ({union}),
ranked AS (SELECT *, {S.average_rank("value", "sample, signal")} / count(*) OVER (PARTITION BY sample, signal) AS x
           FROM signal_rows WHERE value IS NOT NULL)"""


_CONTROLS = ["log_mktcap", "prior_rev_growth_yoy"]
_COMPLETE = "sector IS NOT NULL AND log_mktcap IS NOT NULL AND prior_rev_growth_yoy IS NOT NULL"
_LADDER = f"""{B.BASE_SQL}, {_ranks_sql(SIGNALS, ["sector", *OUTCOMES, *_CONTROLS])},
obs AS ({" UNION ALL ".join(f"SELECT sample, signal, '{o}' AS dv, sector, x, log_mktcap, prior_rev_growth_yoy, {o} AS y FROM ranked WHERE {o} IS NOT NULL AND {_COMPLETE}" for o in OUTCOMES)}),
{hc3_sql("f1", "obs", ["sample", "signal", "dv"], None, "y", ["x"], 50)},
{hc3_sql("f2", "obs", ["sample", "signal", "dv"], "sector", "y", ["x"], 50)},
{hc3_sql("f3", "obs", ["sample", "signal", "dv"], "sector", "y", ["x", "log_mktcap"], 50)},
{hc3_sql("f4", "obs", ["sample", "signal", "dv"], "sector", "y", ["x", *_CONTROLS], 50)},
ladder AS (SELECT '1_univariate' AS spec, * FROM f1 WHERE dv = 'rev_growth_yoy' UNION ALL SELECT '2_sector', * FROM f2 WHERE dv = 'rev_growth_yoy'
           UNION ALL SELECT '3_size', * FROM f3 WHERE dv = 'rev_growth_yoy' UNION ALL SELECT '4_full', * FROM f4),
tested AS (SELECT *, coef / se AS t, {S.z_pvalue("coef / se")} AS p FROM ladder)"""
_FIT = ["coef", "se", "t", "p", "r2"]


@query(
    "spec_ladder",
    "C15 C16 F15 F16 F17 F19 B27 D14 G3",
    f"WITH {_LADDER} SELECT sample, signal, dv, spec, n, {rounded_sql(*_FIT)} FROM tested",
)
def spec_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ols.spec_ladder(base(spark, sf_dir)).select("sample", "signal", "dv", "spec", count("n"), *rounded(*_FIT))


_FDR = f"""{_LADDER},
ordered AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY p, signal, dv) AS i, count(*) OVER (PARTITION BY sample) AS m
            FROM tested WHERE spec = '4_full'),
flags AS (SELECT sample, signal, dv, coalesce(i <= max(CASE WHEN p <= 0.05 * i / m THEN i END) OVER (PARTITION BY sample), false) AS sig FROM ordered)"""


@query(
    "ladder_fdr",
    "F18 D19 G12",
    f"""WITH {_FDR} SELECT t.sample, t.signal, t.dv, t.spec, CAST(f.sig AS INTEGER) AS fdr_significant
        FROM tested t LEFT JOIN flags f ON t.sample = f.sample AND t.signal = f.signal AND t.dv = f.dv""",
)
def ladder_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = ols.add_fdr(ols.spec_ladder(base(spark, sf_dir)))
    return flagged.select("sample", "signal", "dv", "spec", F.col("fdr_significant").cast("int").alias("fdr_significant"))


_SPECS = [s.name for s in ols.LADDER]


@query(
    "ladder_pivot",
    "M2",
    f"""WITH {_LADDER} SELECT sample, signal, {", ".join(f"round(max(CASE WHEN spec = '{s}' THEN {c} END), 6) AS {c}_{s}" for s in _SPECS for c in ("coef", "p"))}
        FROM tested WHERE dv = 'rev_growth_yoy' GROUP BY 1, 2""",
)
def ladder_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = ols.pivot_ladder(ols.spec_ladder(base(spark, sf_dir)))
    return wide.select("sample", "signal", *[F.round(F.col(f"{s}_{c}"), 6).alias(f"{c}_{s}") for s in _SPECS for c in ("coef", "p")])


@query(
    "exclusion_verdicts",
    "F19 C15 I1",
    f"""WITH {_LADDER}
    SELECT a.signal, a.dv, round(a.coef, 6) AS full_coef, round(a.p, 6) AS full_p, a.n AS full_n, round(b.coef, 6) AS excluded_coef,
           round(b.p, 6) AS excluded_p, b.n AS excluded_n, CASE WHEN a.p < 0.05 AND b.p < 0.05 THEN 'SURVIVES'
           WHEN a.p < 0.05 THEN 'LOST significance' ELSE 'n.s. either way' END AS verdict
    FROM tested a JOIN tested b ON a.signal = b.signal AND a.dv = b.dv AND a.sample = 'full' AND b.sample = 'excluded'
         AND a.spec = '4_full' AND b.spec = '4_full'""",
)
def exclusion_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = ols.compare_samples(ols.spec_ladder(base(spark, sf_dir)))
    return result.select(
        "signal", "dv", *rounded("full_coef", "full_p", "excluded_coef", "excluded_p"), count("full_n"), count("excluded_n"), "verdict"
    )


@query(
    "exclusion_placement",
    "F19 I4",
    f"""WITH {B.BASE_SQL}, full_rows AS (SELECT * FROM base WHERE sample = 'full'),
    a AS (SELECT ticker, {S.average_rank("conc")} / count(*) OVER () AS rk FROM full_rows WHERE conc IS NOT NULL),
    b AS (SELECT ticker, {S.average_rank("rev_growth_yoy")} / count(*) OVER () AS rk FROM full_rows WHERE rev_growth_yoy IS NOT NULL)
    SELECT f.ticker, f.conc, round(f.rev_growth_yoy, 6) AS rev_growth_yoy, round(a.rk, 6) AS conc_rk, round(b.rk, 6) AS rev_growth_yoy_rk
    FROM full_rows f LEFT JOIN a USING (ticker) LEFT JOIN b USING (ticker) WHERE f.ticker IN ({B._EXCLUDED_LIST})""",
)
def exclusion_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ols.placement(base(spark, sf_dir), B.EXCLUDED, "conc")
    return placed.select("ticker", count("conc"), *rounded("rev_growth_yoy", "conc_rk", "rev_growth_yoy_rk"))


@query(
    "winsorized_bounds",
    "F15",
    f"""WITH {B.BASE_SQL} SELECT sample, {", ".join(f"round(min({c}), 6) AS low_{c}, round(max({c}), 6) AS high_{c}" for c in ("rev_growth_yoy", "op_margin_delta_yoy", "prior_rev_growth_yoy"))},
        count(builder_rate) AS rates, count(log_mktcap) AS sized FROM base GROUP BY 1""",
)
def winsorized_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["rev_growth_yoy", "op_margin_delta_yoy", "prior_rev_growth_yoy"]
    aggs = [x for c in columns for x in (F.round(F.min(c), 6).alias(f"low_{c}"), F.round(F.max(c), 6).alias(f"high_{c}"))]
    return base(spark, sf_dir).groupBy("sample").agg(*aggs, F.count("builder_rate").alias("rates"), F.count("log_mktcap").alias("sized"))


def _premium_sql(rows: str) -> str:
    infra = K.CATEGORIES[0]
    return f"""WITH {B.BASE_SQL},
    eligible AS (SELECT *, CASE WHEN category = '{infra}' THEN 1.0 ELSE 0.0 END AS is_group FROM base WHERE fwd_ret_4m IS NOT NULL {rows}),
    obs AS (SELECT * FROM eligible WHERE log_mktcap IS NOT NULL AND sector IS NOT NULL),
    {hc3_sql("fit", "obs", ["sample"], "sector", "fwd_ret_4m", ["is_group", "log_mktcap"])},
    means AS (SELECT sample, count(CASE WHEN category = '{infra}' THEN 1 END) AS n_group, avg(CASE WHEN category = '{infra}' THEN fwd_ret_4m END) AS group_mean,
                     avg(CASE WHEN category <> '{infra}' THEN fwd_ret_4m END) AS other_mean FROM eligible GROUP BY 1)
    SELECT sample, n_group, n, {rounded_sql("group_mean", "other_mean", "coef", "se")}, round({S.z_pvalue("coef / se")}, 6) AS p
    FROM means JOIN fit USING (sample)"""


def _premium(result: DataFrame) -> DataFrame:
    return result.select("sample", count("n_group"), count("n"), *rounded("group_mean", "other_mean", "coef", "se", "p"))


@query("group_premium_all_others", "F20", _premium_sql(""))
def group_premium_all_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _premium(ols.group_premium(base(spark, sf_dir), K.CATEGORIES[0]))


@query("group_premium_one_category", "F21", _premium_sql(f"AND category IN ('{K.CATEGORIES[0]}', '{K.CATEGORIES[3]}')"))
def group_premium_one_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _premium(ols.group_premium(base(spark, sf_dir), K.CATEGORIES[0], K.CATEGORIES[3]))


@query(
    "within_category_regression",
    "F22",
    f"""WITH {B.BASE_SQL}, {_ranks_sql(["conc"], ["category", "rev_growth_yoy", *_CONTROLS])},
    obs AS (SELECT * FROM ranked WHERE category IS NOT NULL AND rev_growth_yoy IS NOT NULL AND log_mktcap IS NOT NULL AND prior_rev_growth_yoy IS NOT NULL),
    {hc3_sql("fit", "obs", ["sample", "category"], None, "rev_growth_yoy", ["x", *_CONTROLS], 20)}
    SELECT sample, category, n, {rounded_sql("coef", "se")}, round({S.z_pvalue("coef / se")}, 6) AS p FROM fit""",
)
def within_category_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ols.within_category(base(spark, sf_dir)).select("sample", "category", count("n"), *rounded("coef", "se", "p"))


_ALL_RANKS = ", ".join(
    f"CASE WHEN {s} IS NOT NULL THEN (rank() OVER (PARTITION BY sample ORDER BY {s} NULLS LAST) + (count(*) OVER (PARTITION BY sample, {s}) - 1) / 2.0)"
    f" / count({s}) OVER (PARTITION BY sample) END AS {s}_rk"
    for s in SIGNALS
)
_REPORTED = ["conc", "inv", "adoption_score", "maturity_index", "builder_rate"]


@query(
    "complete_case_regression",
    "F23",
    f"""WITH {B.BASE_SQL}, all_ranks AS (SELECT sample, sector, rev_growth_yoy, log_mktcap, prior_rev_growth_yoy, {_ALL_RANKS} FROM base),
    whole AS (SELECT * FROM all_ranks WHERE {_COMPLETE} AND rev_growth_yoy IS NOT NULL AND {" AND ".join(f"{s}_rk IS NOT NULL" for s in SIGNALS)}),
    obs AS ({" UNION ALL ".join(f"SELECT sample, '{s}' AS signal, sector, rev_growth_yoy, log_mktcap, prior_rev_growth_yoy, {s}_rk AS x FROM whole" for s in _REPORTED)}),
    {hc3_sql("fit", "obs", ["sample", "signal"], "sector", "rev_growth_yoy", ["x", *_CONTROLS])}
    SELECT sample, signal, n, {rounded_sql("coef", "se")}, round({S.z_pvalue("coef / se")}, 6) AS p FROM fit""",
)
def complete_case_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = ols.complete_case(base(spark, sf_dir), SIGNALS, _REPORTED)
    return result.select("sample", "signal", count("n"), *rounded("coef", "se", "p"))


@query(
    "placebo_regression",
    "F24 B35",
    f"""WITH {B.BASE_SQL.replace("base AS (", "prepared AS (")},
    base AS (SELECT *, length(coalesce(ticker, '')) AS namelen FROM prepared),
    {_ranks_sql(["namelen"], ["sector", "rev_growth_yoy", *_CONTROLS])},
    obs AS (SELECT * FROM ranked WHERE {_COMPLETE} AND rev_growth_yoy IS NOT NULL),
    {hc3_sql("fit", "obs", ["sample"], "sector", "rev_growth_yoy", ["x", *_CONTROLS])}
    SELECT sample, n, {rounded_sql("coef", "se")}, round({S.z_pvalue("coef / se")}, 6) AS p FROM fit""",
)
def placebo_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Supplier names all have the same length; tickers do not.
    named = base(spark, sf_dir).withColumn("company_name", F.col("ticker"))
    return ols.placebo(named).select("sample", count("n"), *rounded("coef", "se", "p"))


_PERM_ROWS = f"""{B.BASE_SQL}, {_ranks_sql(["conc"], ["company_id", "sector", "rev_growth_yoy", *_CONTROLS])},
obs AS (SELECT sample, company_id, sector, x, rev_growth_yoy AS y, log_mktcap, prior_rev_growth_yoy FROM ranked
        WHERE {_COMPLETE} AND rev_growth_yoy IS NOT NULL)"""
_PERMUTATIONS = 1000
_KEY = {"k": "CAST('0x' || substr({h}, 1, 12) AS BIGINT)", "a": f"CAST('0x' || substr({{h}}, 13, 8) AS BIGINT) % {permute.PRIME}",
        "b": f"CAST('0x' || substr({{h}}, 21, 8) AS BIGINT) % {permute.PRIME}", "c": "CAST('0x' || substr({h}, 29, 4) AS BIGINT)"}


def _permuted_sql() -> str:
    """Every slot of every replicate with the slot that it takes its signal from, round by round."""
    walk = "SELECT slots.sample, slots.slot, slots.slot AS s, rows, rep, keys FROM slots JOIN sizes USING (sample) CROSS JOIN replicates"
    for r in range(1, permute.ROUNDS + 1):
        k = f"keys[{r}]"
        inner = f"SELECT *, ({k}.k % rows - s + rows) % rows AS m, (greatest(s, m) % {permute.PRIME} * {k}.a + {k}.b) % {permute.PRIME} AS h FROM ({walk})"
        walk = f"SELECT * EXCLUDE (m, h) REPLACE (CASE WHEN (h * h + {k}.c) % {permute.PRIME} % 2 = 1 THEN m ELSE s END AS s) FROM ({inner})"
    return walk


@query(
    "permutation_test",
    "F25",
    f"""WITH {_PERM_ROWS}, {hc3_sql("fit", "obs", ["sample"], "sector", "y", ["x", *_CONTROLS])},
    slots AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY company_id) - 1 AS slot FROM obs),
    sizes AS (SELECT sample, count(*) AS rows FROM obs GROUP BY 1),
    replicates AS (SELECT rep, list_transform(range(1, {permute.ROUNDS + 1}), lambda r: {{{", ".join(f"'{n}': " + t.format(h="md5('12345:' || rep || ':' || r)") for n, t in _KEY.items())}}}) AS keys
                   FROM (SELECT unnest(range(1, {_PERMUTATIONS + 1})) AS rep)),
    reps AS ({_permuted_sql()}),
    shuffled AS (SELECT s.sample, r.rep, s.sector, t.x, s.y, s.log_mktcap, s.prior_rev_growth_yoy
                 FROM reps r JOIN slots s ON s.sample = r.sample AND s.slot = r.slot JOIN slots t ON t.sample = r.sample AND t.slot = r.s),
    {hc3_sql("perm", "shuffled", ["sample", "rep"], "sector", "y", ["x", *_CONTROLS])}
    SELECT f.sample, max(f.n) AS n, round(max(f.coef), 6) AS obs_coef, {_PERMUTATIONS} AS n_perm,
           count(CASE WHEN abs(p.coef) >= abs(f.coef) THEN 1 END) AS n_ge,
           round((count(CASE WHEN abs(p.coef) >= abs(f.coef) THEN 1 END) + 1) / {_PERMUTATIONS + 1}.0, 6) AS p
    FROM fit f JOIN perm p ON f.sample = p.sample GROUP BY 1""",
)
def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = ols.permutation_test(base(spark, sf_dir), "company_id", n_perm=_PERMUTATIONS)
    return result.select("sample", count("n"), *rounded("obs_coef", "p"), count("n_perm"), count("n_ge"))


_LEFT_OUT = f"""{B.BASE_SQL}, {_ranks_sql(["conc"], ["sector", "rev_growth_yoy", *_CONTROLS])},
clean AS (SELECT * FROM ranked WHERE {_COMPLETE} AND rev_growth_yoy IS NOT NULL),
obs AS (SELECT c.*, s.sector AS left_out FROM clean c JOIN (SELECT DISTINCT sample, sector FROM clean) s ON c.sample = s.sample AND c.sector <> s.sector),
{hc3_sql("fit", "obs", ["sample", "left_out"], "sector", "rev_growth_yoy", ["x", *_CONTROLS])},
tested AS (SELECT *, coef / se AS t, {S.z_pvalue("coef / se")} AS p FROM fit)"""


@query(
    "leave_one_sector_out",
    "F26",
    f"WITH {_LEFT_OUT} SELECT sample, left_out, n, {rounded_sql('coef', 'se', 'p')} FROM tested",
)
def leave_one_sector_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ols.leave_one_out(base(spark, sf_dir)).select("sample", "left_out", count("n"), *rounded("coef", "se", "p"))


@query(
    "leave_one_sector_out_summary",
    "F26",
    f"""WITH {_LEFT_OUT} SELECT sample, arg_max(left_out, p) AS worst_sector, round(arg_max(coef, p), 6) AS worst_coef, round(max(p), 6) AS worst_p,
        count(CASE WHEN p < 0.05 THEN 1 END) AS n_significant, count(*) AS n_sectors FROM tested GROUP BY 1""",
)
def leave_one_sector_out_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = ols.summarize_leave_one_out(ols.leave_one_out(base(spark, sf_dir)))
    return result.select("sample", "worst_sector", *rounded("worst_coef", "worst_p"), count("n_significant"), count("n_sectors"))


@query(
    "line_regression_hc3",
    "F16 F22",
    f"""WITH obs AS (SELECT l_returnflag AS flag, l_linestatus AS grp, ln(l_extendedprice) AS y, l_quantity AS x, l_discount AS d, l_tax AS t
                     FROM lineitem WHERE l_extendedprice > 0),
    {hc3_sql("f1", "obs", ["flag"], None, "y", ["x"])}, {hc3_sql("f3", "obs", ["flag"], "grp", "y", ["x", "d", "t"])}
    SELECT flag, spec, n, round(coef, 8) AS coef, round(se, 8) AS se, round(r2, 6) AS r2
    FROM (SELECT 'simple' AS spec, * FROM f1 UNION ALL SELECT 'controls', * FROM f3)""",
)
def line_regression_hc3(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = B.table(spark, sf_dir, "lineitem").where(F.col("l_extendedprice") > 0)
    rows = lines.select(
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("grp"), F.log("l_extendedprice").alias("y"),
        F.col("l_quantity").alias("x"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"),
    )
    specs = [ols.Spec("simple", ("x",), False), ols.Spec("controls", ("x", "d", "t"), True)]
    result = ols.hc3_regressions(rows, ["flag"], "grp", "y", specs)
    return result.select("flag", "spec", count("n"), *rounded("coef", "se", places=8), *rounded("r2"))


# --- pooled panel regressions: the SQL inverts the full dummy matrix by sweeping --------------------

_POOLED_SIGNALS = K.DEFAULT_SIGNALS
_POOLED_OUTCOMES = K.IC_OUTCOMES


def pooled_sql(signals: list[str], outcomes: list[str], tail: str) -> str:
    """Gauss-Jordan over the (term x term) cross-product matrix, one pivot per recursion step."""
    controls = K.DEFAULT_CONTROLS
    long = S.pairs("panel", ["sector", "quarter", *controls], signals, outcomes)
    clean = " AND ".join(f"{c} IS NOT NULL" for c in ["sector", "quarter", "x", "y", *controls])
    terms = (
        "list_concat([struct_pack(k := '0|Intercept', v := 1.0), "
        + ", ".join(f"struct_pack(k := '9{i}|{c}', v := {c})" for i, c in enumerate(["x", *controls]))
        + ", struct_pack(k := '~y', v := y)], "
        "CASE WHEN sector > (SELECT min(sector) FROM clean) THEN [struct_pack(k := '1|C(sector)[T.' || sector || ']', v := 1.0)] ELSE [] END, "
        "CASE WHEN quarter > q0 THEN [struct_pack(k := '2|C(quarter)[T.' || quarter || ']', v := 1.0)] ELSE [] END)"
    )
    return f"""WITH RECURSIVE {B.PANEL_SQL}, long AS ({long}), clean AS (
      SELECT *, min(quarter) OVER (PARTITION BY signal, outcome) AS q0, row_number() OVER () AS id FROM long WHERE {clean}),
    parts AS (SELECT signal, outcome, id, unnest({terms}) AS t FROM clean),
    flat AS (SELECT signal, outcome, id, t.k AS k, t.v AS v FROM parts),
    names AS (SELECT signal, outcome, k, row_number() OVER (PARTITION BY signal, outcome ORDER BY k) AS j FROM (SELECT DISTINCT signal, outcome, k FROM flat)),
    indexed AS (SELECT f.signal, f.outcome, f.id, n.j, f.v FROM flat f JOIN names n ON f.signal = n.signal AND f.outcome = n.outcome AND f.k = n.k),
    sums AS (SELECT a.signal, a.outcome, a.j AS r, b.j AS c, sum(a.v * b.v) AS v FROM indexed a JOIN indexed b
             ON a.signal = b.signal AND a.outcome = b.outcome AND a.id = b.id GROUP BY ALL),
    gram AS (SELECT a.signal, a.outcome, a.j AS r, b.j AS c, coalesce(s.v, 0.0) AS v FROM names a JOIN names b ON a.signal = b.signal AND a.outcome = b.outcome
             LEFT JOIN sums s ON s.signal = a.signal AND s.outcome = a.outcome AND s.r = a.j AND s.c = b.j),
    sizes AS (SELECT signal, outcome, max(j) - 1 AS p FROM names GROUP BY 1, 2),
    counts AS (SELECT signal, outcome, count(*) AS n, sum((y - m) * (y - m)) AS tss
               FROM (SELECT signal, outcome, y, avg(y) OVER (PARTITION BY signal, outcome) AS m FROM clean) GROUP BY 1, 2),
    sweep AS (
      SELECT CAST(0 AS BIGINT) AS step, g.signal, g.outcome, g.r, g.c, g.v, z.p FROM gram g JOIN sizes z ON g.signal = z.signal AND g.outcome = z.outcome
      UNION ALL
      SELECT step + 1, signal, outcome, r, c,
             CASE WHEN r = step + 1 AND c = step + 1 THEN 1 / pv WHEN r = step + 1 THEN v / pv WHEN c = step + 1 THEN -v / pv
                  ELSE v - cv * lv / pv END, p
      FROM (SELECT step, signal, outcome, r, c, v, p,
                   max(CASE WHEN r = step + 1 AND c = step + 1 THEN v END) OVER (PARTITION BY signal, outcome) AS pv,
                   max(CASE WHEN c = step + 1 THEN v END) OVER (PARTITION BY signal, outcome, r) AS cv,
                   max(CASE WHEN r = step + 1 THEN v END) OVER (PARTITION BY signal, outcome, c) AS lv
            FROM sweep WHERE step < p)),
    done AS (SELECT * FROM sweep WHERE step = p),
    fit AS (
      SELECT b.signal, b.outcome, CASE WHEN split_part(n.k, '|', 2) = 'x' THEN b.signal ELSE split_part(n.k, '|', 2) END AS term,
             b.v AS coefficient, sqrt(i.v * rss.v / (k.n - b.p)) AS std_error, k.n AS nobs, 1 - rss.v / k.tss AS r_squared, k.n - b.p AS df
      FROM done b JOIN names n ON n.signal = b.signal AND n.outcome = b.outcome AND n.j = b.r
      JOIN done i ON i.signal = b.signal AND i.outcome = b.outcome AND i.r = b.r AND i.c = b.r
      JOIN done rss ON rss.signal = b.signal AND rss.outcome = b.outcome AND rss.r = b.p + 1 AND rss.c = b.p + 1
      JOIN counts k ON k.signal = b.signal AND k.outcome = b.outcome
      WHERE b.c = b.p + 1 AND b.r <= b.p)
    {tail}"""


@query(
    "pooled_regression_grid",
    "F12 F14",
    pooled_sql(
        _POOLED_SIGNALS,
        _POOLED_OUTCOMES,
        f"""SELECT signal, outcome, term, round(coefficient, 6) AS coefficient, round(std_error, 6) AS std_error,
            round(coefficient / std_error, 5) AS t_stat, round({S.t_pvalue("coefficient / std_error", "df")}, 6) AS p_value,
            nobs, round(r_squared, 6) AS r_squared FROM fit""",
    ),
)
def pooled_regression_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, _ = ols.pooled_regressions(B.panel(spark, sf_dir), _POOLED_SIGNALS, _POOLED_OUTCOMES)
    return terms.select(
        "signal", "outcome", "term", *rounded("coefficient", "std_error", "p_value", "r_squared"), *rounded("t_stat", places=5), count("nobs")
    )


@query(
    "baseline_regression",
    "F13 B37",
    pooled_sql(
        [K.COMPOSITE], ["fwd_return_1q"],
        "SELECT term, round(coefficient, 6) AS coefficient, round(std_error, 6) AS std_error, nobs FROM fit",
    ),
)
def baseline_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = ols.baseline_regression(B.panel(spark, sf_dir), K.COMPOSITE, "fwd_return_1q")
    return result.select("term", *rounded("coefficient", "std_error"), count("nobs"))


_FORMULA = " + ".join([K.COMPOSITE, *K.DEFAULT_CONTROLS, "C(sector)", "C(quarter)"])


@query(
    "pooled_regression_warnings",
    "F12",
    f"""WITH {B.PANEL_SQL} SELECT '{K.COMPOSITE}' AS signal, 'fwd_return_1q' AS outcome, count(*) AS nobs,
        count(*) || ' rows are fewer than the 1000000 asked for' AS warning, 'fwd_return_1q ~ {_FORMULA}' AS formula
        FROM panel WHERE {" AND ".join(f"{c} IS NOT NULL" for c in [K.COMPOSITE, "fwd_return_1q", "sector", "quarter", *K.DEFAULT_CONTROLS])}""",
)
def pooled_regression_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, warnings = ols.pooled_regressions(B.panel(spark, sf_dir), [K.COMPOSITE], ["fwd_return_1q"], min_obs=1_000_000)
    return warnings.select("signal", "outcome", count("nobs"), "warning", "formula")


# --- cross-section ICs and sorts live here because they read the same prepared table -----------------


@query(
    "cross_section_ic",
    "F7 B35",
    f"""WITH {B.BASE_SQL}, full_rows AS (SELECT * FROM base WHERE sample = 'full'), long AS ({S.pairs("full_rows", [], SIGNALS, OUTCOMES)}),
    {S.spearman_groups("long", "signal, outcome", 10)}
    SELECT signal, outcome, n_obs, round(ic, 6) AS ic, status, round({S.correlation_pvalue("ic", "n_obs")}, 6) AS p_value FROM ics""",
)
def cross_section_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = ic.ic_matrix(base(spark, sf_dir).where(F.col("sample") == "full"), SIGNALS, OUTCOMES)
    return result.select("signal", "outcome", count("n_obs"), *rounded("ic", "p_value"), "status")


@query(
    "entity_rate_agreement",
    "F34",
    f"""WITH {B.VINTAGE_SQL}, long AS (SELECT 0 AS k, builder_rate AS x, adoption_score AS y FROM vintage), {S.spearman_groups("long", "k", 3)}
    SELECT n_obs, round(ic, 6) AS ic, status FROM ics""",
)
def entity_rate_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = B.vintage(spark, sf_dir)
    rates = table.select("company_id", F.col("builder_rate").alias("x"))
    other = table.select("company_id", F.col("adoption_score").alias("y"))
    return ic.spearman(rates.join(other, "company_id"), []).select(count("n_obs"), *rounded("ic"), "status")


def _block_sql(block: str, key: str, statistics: str, rows: str) -> str:
    names = [x.strip() for x in statistics.split(",")]
    return f"""SELECT sample, '{block}' AS block, CAST({key} AS VARCHAR) AS key, UNNEST([{", ".join(f"'{x}'" for x in names)}]) AS statistic,
        UNNEST([{", ".join(f"CAST({x} AS DOUBLE)" for x in names)}]) AS value FROM ({rows})"""


def _registered(name: str) -> str:
    return QUERIES[name].sql


_COUNTED = [*dict.fromkeys([*numbers.COVERAGE, *OUTCOMES, "op_margin_delta_yoy", "fwd_ret_4m", "prior_rev_growth_yoy"])]
_SORTED = f"""WITH {B.BASE_SQL}, rows AS (SELECT sample, maturity_index AS s, {{0}} AS y, company_id FROM base WHERE maturity_index IS NOT NULL AND {{0}} IS NOT NULL),
    q AS (SELECT sample, y, {S.quantile_label("s", "company_id", "sample")} AS quantile FROM rows)
    SELECT sample, quantile, avg(y) AS mean, count(*) AS n FROM q GROUP BY 1, 2"""
_TRIO = [K.PRIMARY_OUTCOME, "op_margin_delta_yoy", "fwd_ret_4m"]
ALL_NUMBERS_SQL = " UNION ALL ".join(
    [
        _block_sql("ladder", "signal || '/' || dv || '/' || spec", "n, coef, se, p", _registered("spec_ladder")),
        _block_sql("premium", "'all others'", "n, coef, se, p", _registered("group_premium_all_others")),
        _block_sql("premium", f"'{K.CATEGORIES[3]}'", "n, coef, se, p", _registered("group_premium_one_category")),
        _block_sql("within_category", "category", "n, coef, se, p", _registered("within_category_regression")),
        _block_sql("complete_case", "signal", "n, coef, se, p", _registered("complete_case_regression")),
        _block_sql("placebo", "'name length'", "n, coef, se, p", _registered("placebo_regression")),
        _block_sql("leave_one_out", "left_out", "n, coef, se, p", _registered("leave_one_sector_out")),
        _block_sql("leave_one_out_summary", "worst_sector", "worst_coef, worst_p, n_significant, n_sectors", _registered("leave_one_sector_out_summary")),
        _block_sql("permutation", "'conc'", "n, obs_coef, p, n_perm, n_ge", _registered("permutation_test")),
        _block_sql(
            "rank_correlation", "signal || '/' || outcome", "n, rho, p",
            f"""WITH {B.BASE_SQL}, long AS ({S.pairs("base", ["sample"], SIGNALS, _TRIO)}), {S.spearman_groups("long", "sample, signal, outcome", 10)}
            SELECT sample, signal, outcome, n_obs AS n, ic AS rho, {S.correlation_pvalue("ic", "n_obs")} AS p FROM ics""",
        ),
        _block_sql("score_bins", "CAST(conc AS INTEGER)", "mean, n", f"WITH {B.BASE_SQL} SELECT sample, conc, avg(rev_growth_yoy) AS mean, count(*) AS n FROM base WHERE conc IS NOT NULL AND rev_growth_yoy IS NOT NULL GROUP BY 1, 2"),
        _block_sql(
            "high_minus_low", "'conc'", "diff, t, n_hi, n_lo",
            f"""WITH {B.BASE_SQL}, s AS (SELECT sample, avg(rev_growth_yoy) FILTER (conc IN (4, 5)) AS mh, avg(rev_growth_yoy) FILTER (conc IN (1, 2)) AS ml,
              var_samp(rev_growth_yoy) FILTER (conc IN (4, 5)) AS vh, var_samp(rev_growth_yoy) FILTER (conc IN (1, 2)) AS vl,
              count(rev_growth_yoy) FILTER (conc IN (4, 5)) AS n_hi, count(rev_growth_yoy) FILTER (conc IN (1, 2)) AS n_lo FROM base GROUP BY 1)
            SELECT sample, mh - ml AS diff, (mh - ml) / sqrt(vh / n_hi + vl / n_lo) AS t, n_hi, n_lo FROM s""",
        ),
        _block_sql("category_return", "category", "mean, n", f"WITH {B.BASE_SQL} SELECT sample, category, avg(fwd_ret_4m) AS mean, count(*) AS n FROM base WHERE category IS NOT NULL AND fwd_ret_4m IS NOT NULL GROUP BY 1, 2"),
        _block_sql("coverage", "'rows'", ", ".join(["total", *_COUNTED]), f"WITH {B.BASE_SQL} SELECT sample, count(*) AS total, {', '.join(f'count({c}) AS {c}' for c in _COUNTED)} FROM base GROUP BY 1"),
        *[_block_sql("quantile_means", f"'{y}/' || quantile", "mean, n", _SORTED.format(y)) for y in (K.PRIMARY_OUTCOME, "fwd_ret_4m")],
    ]
)


@query("all_numbers", "C15 E14 E15 E16 E17 F16 F19 F20 F21 F22 F23 F24 F25 F26 F27", f"SELECT sample, block, key, statistic, round(value, 6) AS value FROM ({ALL_NUMBERS_SQL})")
def all_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both samples; the company's name is its ticker, since supplier names all have the same length."""
    named = base(spark, sf_dir).withColumn("company_name", F.col("ticker"))
    return numbers.all_numbers(named, "company_id", n_perm=_PERMUTATIONS).select(*numbers.SCHEMA[:4], *rounded("value"))
