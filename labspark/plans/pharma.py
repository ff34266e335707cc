"""Pharmacokinetic queries over the concentration view, and closed forms over numeric columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from labspark.operators import nca, pk
from labspark.operators.biologics import docking_estimate
from labspark.plans.views import CONC, concentrations, rounded
from labspark.tables import table

DOSE = 100.0
REPORT = ("auc_last", "lambda_z", "auc_inf", "percent_extrapolated", "half_life", "clearance", "vz", "mrt", "vss")


def _items(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice")


KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
_KEY = ", ".join(KEY)


class _Inputs:
    """Line items as dose levels, constants and times."""

    def __init__(self) -> None:
        quantity, tax, discount, price = (F.col(f"l_{c}") for c in ("quantity", "tax", "discount", "extendedprice"))
        self.s, self.km, self.ic50, self.price, self.line = quantity, quantity / 4 + 1, price / 997, price, F.col("l_linenumber")
        self.ki, self.fm = tax + 0.01, F.least(discount * 9, F.lit(0.95))
        self.ke, self.ka, self.t, self.tax, self.discount = tax + 0.05, discount + 0.3, quantity / 2, tax, discount


def _closed(exprs, *names):
    def query(s, d):
        made = exprs(_Inputs())
        return rounded(_items(s, d).select(*KEY, *(e.alias(n) for e, n in zip(made, names, strict=True))), *names)

    return query


def _occupancy(s, d):
    return rounded(pk.time_above(concentrations(s, d), kd=10.0), "hours_above")


def _schild(s, d):
    items = _items(s, d).filter("l_quantity > 0").select(F.col("l_suppkey").alias("agonist"), F.log10(F.col("l_quantity") / 1e6).alias("log_b"), F.log10(F.col("l_quantity") * (1 + F.col("l_discount"))).alias("log_dr1"))
    return rounded(pk.schild(items, "agonist"), "slope", "intercept", "pa2")


def _availability(measured):
    """Oral availability of line items as compounds; FLOW is a hepatic flow in L/h."""

    def query(s, d):
        line, log_p, tpsa = F.col("l_linenumber"), F.col("l_tax") * 50, F.col("l_quantity") * 3
        groups = {"catechol": line == 5, "ester": line % 2 == 0, "mao_amine": line % 3 == 0, "aryl_ketone": F.col("l_returnflag") == "R", "phenol": line > 3}
        hia = pk.intestinal_absorption(tpsa, line, F.col("l_extendedprice") / 150, log_p)
        found = pk.hepatic_availability(hia, log_p, groups, FLOW, F.when(line != 1, F.log1p("l_quantity")) if measured else None)
        return rounded(table(s, d, "lineitem").select(*KEY, *(c.alias(n) for n, c in found.items())), "clint", "first_pass", "clearance", "oral")

    return query


FLOW = 90.0


QUERIES = {
    "hepatic_availability": _availability(False),
    "measured_availability": _availability(True),
    "efflux_and_brain": lambda s, d: _items(s, d).select(*KEY, pk.efflux_substrate(F.col("l_extendedprice") / 100, F.col("l_linenumber"), F.col("l_quantity") * 3).alias("efflux"), pk.reaches_brain(F.col("l_tax") * 50, F.col("l_quantity") * 3, F.col("l_extendedprice") / 150).alias("brain")),
    "nca_auc": lambda s, d: rounded(nca.exposure(concentrations(s, d)), "auc_last", "aumc_last", "t_last", places=4),
    "nca_cmax": lambda s, d: rounded(nca.peaks(concentrations(s, d)), "tmax"),
    "nca_lambda_z": lambda s, d: rounded(nca.lambda_z(concentrations(s, d)).select("subject", "lambda_z", "n_points", "adj_r2"), "lambda_z", "adj_r2"),
    "nca_full": lambda s, d: rounded(nca.nca(concentrations(s, d), DOSE), "tmax", *REPORT, places=4),
    "bands": lambda s, d: rounded(nca.bands(concentrations(s, d), F.floor(F.col("t") / 24)), "p5", "p50", "p95"),
    "occupancy_time": _occupancy,
    "cheng_prusoff": _closed(lambda x: [pk.cheng_prusoff(x.ic50, x.s, x.km, m) for m in ("competitive", "noncompetitive", "uncompetitive", "mixed")], "competitive", "noncompetitive", "uncompetitive", "mixed"),
    "ddi_auc_ratio": _closed(lambda x: [pk.auc_ratio(x.s / 10, x.ki, x.fm), pk.auc_ratio(x.s / 10, x.ki, x.fm, kinact=x.tax, kdeg=F.lit(0.02)), pk.auc_ceiling(x.fm)], "reversible", "with_inactivation", "ceiling"),
    "bateman": _closed(lambda x: [pk.bateman(F.lit(DOSE), F.lit(0.8), F.lit(20.0), x.ka, x.ke, x.t), pk.accumulation(x.ke, F.lit(12.0))], "c", "accumulation"),
    "ligand_eff": _closed(lambda x: [pk.delta_g(x.ic50 * 1e-9), pk.ligand_efficiency(x.ic50 * 1e-9, x.line + 10)], "delta_g", "le"),
    "ph_solubility": _closed(lambda x: [F.log10(pk.solubility(x.price, x.s / 5, x.tax * 100, acid)) for acid in (True, False)], "acid", "base"),
    "buffer_beta": _closed(lambda x: [pk.buffer_capacity(x.s / 5 + 1, x.tax, F.lit(4.76))], "beta"),
    "absorption": _closed(lambda x: [pk.intestinal_absorption(x.s * 3, x.line, x.price / 150, x.tax * 50), pk.log_bb(x.tax * 50, x.s * 3), pk.caco2(x.tax * 50, x.s * 3)], "hia", "log_bb", "caco2"),
    "impairment": _closed(lambda x: [pk.impairment_ratio(x.fm, x.discount + 0.2, x.tax + 0.3)], "ratio"),
    "schild": _schild,
    "efficiencies": _closed(lambda x: [pk.lipophilic_efficiency(x.km, x.ki * 30), pk.lipophilicity_price(x.line / 10, x.ki * 30), pk.binding_efficiency(x.km, x.price / 100), pk.surface_efficiency(x.km, x.s * 3)], "lle", "lelp", "bei", "sei"),
    "steady_state": _closed(lambda x: [pk.average_at_steady_state(F.lit(0.8), F.lit(DOSE), x.ke, x.s)], "c_avg"),
    "basic_ddi": _closed(lambda x: [pk.basic_inhibition(x.s / 10, x.ki), pk.basic_inactivation(x.s / 10, x.ki, x.tax, F.lit(0.02))], "r1", "r2"),
    "general_solubility": _closed(lambda x: [pk.general_solubility(x.s * 5, x.tax * 50)], "log_s"),
    "double_reciprocal": _closed(lambda x: pk.double_reciprocal(x.s, x.discount), "inverse_s", "inverse_v"),
    "docking_estimate": _closed(lambda x: [docking_estimate(x.tax * 50, x.price / 100), docking_estimate(x.tax * 50, x.price / 100, 6)], "first_pose", "last_pose"),
}

_SEG = f"""WITH {CONC}, seg AS (SELECT *, lag(t) OVER w AS t0, lag(c) OVER w AS c0 FROM conc WINDOW w AS (PARTITION BY subject ORDER BY t)),
part AS (SELECT *, CASE WHEN c < c0 AND c > 0 AND c0 > 0 THEN (t - t0) * (c0 - c) / ln(c0 / c) ELSE (t - t0) * (c0 + c) / 2 END AS auc,
  CASE WHEN c < c0 AND c > 0 AND c0 > 0 THEN (t - t0) * (t0 * c0 - t * c) / ln(c0 / c) + (t - t0) * (t - t0) * (c0 - c) / pow(ln(c0 / c), 2) ELSE (t - t0) * (t0 * c0 + t * c) / 2 END AS aumc FROM seg),
ex AS (SELECT subject, count(*) AS n, coalesce(sum(auc), 0.0) AS auc_last, coalesce(sum(aumc), 0.0) AS aumc_last, max(t) AS t_last FROM part GROUP BY subject),
peak AS (SELECT subject, max(c) AS cmax, arg_max(t, (c, -t)) AS tmax FROM conc GROUP BY subject),
post AS (SELECT subject, t, ln(c) AS y FROM conc JOIN peak USING (subject) WHERE t > tmax AND c > 0),
fit AS (SELECT p.subject, p.t AS start, count(*) AS k, regr_slope(q.y, q.t) AS slope, regr_intercept(q.y, q.t) AS icept, regr_r2(q.y, q.t) AS r2
  FROM post p JOIN post q ON p.subject = q.subject AND q.t >= p.t GROUP BY 1, 2 HAVING count(*) >= 3),
adj AS (SELECT *, 1 - (1 - r2) * (k - 1) / (k - 2) AS adj_r2 FROM fit WHERE slope < 0),
lz AS (SELECT subject, -slope AS lambda_z, icept, k AS n_points, adj_r2 FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY round(adj_r2, 12) DESC, start) AS rn FROM adj) WHERE rn = 1)"""

_R = "round({}, 6) + 0.0::DOUBLE AS {}"


def _closed_sql(**exprs):
    return f"SELECT {_KEY}, " + ", ".join(_R.format(e, n) for n, e in exprs.items()) + " FROM lineitem"


_I, _K, _F = "l_quantity / 10", "(l_tax + 0.01::DOUBLE)", "least(l_discount * 9, 0.95::DOUBLE)"
_C = f"(1 / (1 + {_I} / {_K}))"
_A = f"(0.02::DOUBLE / (0.02::DOUBLE + l_tax * ({_I}) / ({_K} + {_I})))"
_KE, _KA, _T = "(l_tax + 0.05::DOUBLE)", "(l_discount + 0.3::DOUBLE)", "(l_quantity / 2)"
_PH = "(l_quantity / 5)"
_P = "(l_quantity / 4 + 1)"
_FIRST_PASS = f"""WITH r AS (SELECT *, l_linenumber = 5 AS catechol, l_linenumber % 2 = 0 AS ester, l_linenumber % 3 = 0 AS amine, l_returnflag = 'R' AS ketone, l_linenumber IN (4, 6, 7) AS phenol,
  least(99, greatest(5, 100 - 0.7::DOUBLE * greatest(0, l_quantity * 3 - 60) - 4 * greatest(0, l_linenumber - 3) - 0.05::DOUBLE * greatest(0, l_extendedprice / 150 - 480) - 6 * greatest(0, -1 - l_tax * 50))) AS hia FROM lineitem),
a AS (SELECT *, {FLOW}::DOUBLE * (0.05::DOUBLE + 0.08::DOUBLE * greatest(0, l_tax * 50 - 2) + CASE WHEN catechol THEN 15 ELSE 0 END + CASE WHEN ester THEN 2.2::DOUBLE ELSE 0 END + CASE WHEN amine THEN 2.5::DOUBLE ELSE 0 END
  + CASE WHEN ketone THEN 0.9::DOUBLE ELSE 0 END + CASE WHEN phenol THEN 0.3::DOUBLE ELSE 0 END) AS assumed,
  CASE WHEN catechol THEN 'catechol conjugation and deamination' WHEN ester THEN 'ester hydrolysis' WHEN amine THEN 'amine deamination' WHEN ketone THEN 'carbonyl reduction' WHEN phenol THEN 'phenol conjugation' ELSE 'little first-pass metabolism' END AS told FROM r)"""


def _availability_sql(clint, route):
    q = f"{FLOW}::DOUBLE"
    return f"""{_FIRST_PASS}, c AS (SELECT *, {clint} AS cl, {route} AS way FROM a)
SELECT {_KEY}, round(cl, 6) AS clint, round({q} / ({q} + cl), 6) AS first_pass, round(cl * ({q} / ({q} + cl)), 6) AS clearance, round(least(99, greatest(1, hia * ({q} / ({q} + cl)))), 6) AS oral, way AS route FROM c"""


ORACLES = {
    "hepatic_availability": _availability_sql("assumed", "told"),
    "measured_availability": _availability_sql("CASE WHEN l_linenumber <> 1 THEN ln(1 + l_quantity) ELSE assumed END", "CASE WHEN l_linenumber <> 1 THEN 'measured intrinsic clearance' ELSE told END"),
    "efflux_and_brain": f"SELECT {_KEY}, (l_extendedprice / 100 > 400 AND l_linenumber >= 6) OR l_quantity * 3 > 120 AS efflux, least(1.2::DOUBLE, greatest(-2, 0.15::DOUBLE + 0.17::DOUBLE * (l_tax * 50) - 0.011::DOUBLE * (l_quantity * 3))) > -0.3::DOUBLE AND l_quantity * 3 < 90 AND l_extendedprice / 150 < 450 AS brain FROM lineitem",
    "efficiencies": _closed_sql(lle=f"{_P} - {_K} * 30", lelp=f"{_K} * 30 / (l_linenumber / 10)", bei=f"{_P} / (l_extendedprice / 100 / 1000)", sei=f"{_P} / (l_quantity * 3 / 100)"),
    "steady_state": _closed_sql(c_avg=f"0.8::DOUBLE * {DOSE}::DOUBLE / ({_KE} * l_quantity)"),
    "basic_ddi": _closed_sql(r1=f"1 + {_I} / {_K}", r2=f"1 + l_tax * ({_I}) / (({_K} + {_I}) * 0.02::DOUBLE)"),
    "general_solubility": _closed_sql(log_s="0.5::DOUBLE - 0.01::DOUBLE * greatest(0, l_quantity * 5 - 25) - l_tax * 50"),
    "double_reciprocal": _closed_sql(inverse_s="CASE WHEN l_quantity > 0 AND l_discount > 0 THEN 1 / l_quantity END", inverse_v="CASE WHEN l_quantity > 0 AND l_discount > 0 THEN 1 / l_discount END"),
    "docking_estimate": _closed_sql(first_pose="-(5 + 0.8::DOUBLE * (l_tax * 50) + 0.004::DOUBLE * (l_extendedprice / 100))", last_pose="-(5 + 0.8::DOUBLE * (l_tax * 50) + 0.004::DOUBLE * (l_extendedprice / 100)) + 1.75::DOUBLE"),
    "nca_auc": f"{_SEG} SELECT subject, n, round(auc_last, 4) AS auc_last, round(aumc_last, 4) AS aumc_last, round(t_last, 4) AS t_last, true AS increasing FROM ex",
    "nca_cmax": f"{_SEG} SELECT subject, cmax, round(tmax, 6) AS tmax FROM peak",
    "nca_lambda_z": f"{_SEG} SELECT subject, round(lambda_z, 6) AS lambda_z, n_points, round(adj_r2, 6) AS adj_r2 FROM lz",
    "nca_full": f"""{_SEG}, r AS (SELECT *, exp(icept - lambda_z * t_last) AS cl_, auc_last + exp(icept - lambda_z * t_last) / lambda_z AS auc_inf FROM ex JOIN peak USING (subject) LEFT JOIN lz USING (subject)),
q AS (SELECT *, (aumc_last + t_last * cl_ / lambda_z + cl_ / (lambda_z * lambda_z)) / auc_inf AS mrt_, {DOSE}::DOUBLE / auc_inf AS cl FROM r)
SELECT subject, n, cmax, round(tmax, 4) AS tmax, round(auc_last, 4) AS auc_last, round(lambda_z, 4) AS lambda_z, n_points, round(auc_inf, 4) AS auc_inf,
  round(100 * (auc_inf - auc_last) / auc_inf, 4) AS percent_extrapolated, round(0.6931471805599453::DOUBLE / lambda_z, 4) AS half_life, round(cl, 4) AS clearance,
  round(cl / lambda_z, 4) AS vz, round(mrt_, 4) AS mrt, round(cl * mrt_, 4) AS vss, CASE WHEN lambda_z IS NULL THEN 'no terminal slope' END AS refusal FROM q""",
    "bands": f"WITH {CONC} SELECT CAST(floor(t / 24) AS BIGINT) AS bin, count(*) AS n, round(quantile_cont(c, 0.05), 6) AS p5, round(quantile_cont(c, 0.5), 6) AS p50, round(quantile_cont(c, 0.95), 6) AS p95 FROM conc GROUP BY 1",
    "occupancy_time": f"""WITH {CONC}, seg AS (SELECT *, lead(t) OVER w AS t1, lead(c) OVER w AS c1 FROM conc WINDOW w AS (PARTITION BY subject ORDER BY t))
SELECT subject, round(sum(CASE WHEN c1 IS NULL THEN 0 WHEN c >= 10 AND c1 >= 10 THEN t1 - t WHEN c >= 10 THEN (t1 - t) * (c - 10) / (c - c1) WHEN c1 >= 10 THEN (t1 - t) * (c1 - 10) / (c1 - c) ELSE 0 END), 6) AS hours_above FROM seg GROUP BY subject""",
    "cheng_prusoff": _closed_sql(competitive="l_extendedprice / 997 / (1 + l_quantity / (l_quantity / 4 + 1))", noncompetitive="l_extendedprice / 997", uncompetitive="l_extendedprice / 997 / (1 + (l_quantity / 4 + 1) / nullif(l_quantity, 0))", mixed="CAST(NULL AS DOUBLE)"),
    "ddi_auc_ratio": _closed_sql(reversible=f"1 / ({_C} * {_F} + 1 - {_F})", with_inactivation=f"1 / ({_A} * {_C} * {_F} + 1 - {_F})", ceiling=f"1 / (1 - {_F})"),
    "bateman": _closed_sql(
        c=f"CASE WHEN abs({_KA} - {_KE}) < 1e-9 THEN 0.8::DOUBLE * 100 * {_KE} * {_T} * exp(-{_KE} * {_T}) / 20 ELSE 0.8::DOUBLE * 100 * {_KA} / (20 * ({_KA} - {_KE})) * (exp(-{_KE} * {_T}) - exp(-{_KA} * {_T})) END",
        accumulation=f"1 / (1 - exp(-{_KE} * 12))",
    ),
    "ligand_eff": _closed_sql(delta_g="1.987204259e-3::DOUBLE * 298.15::DOUBLE * ln(l_extendedprice / 997 * 1e-9::DOUBLE)", le="-(1.987204259e-3::DOUBLE * 298.15::DOUBLE * ln(l_extendedprice / 997 * 1e-9::DOUBLE)) / (l_linenumber + 10)"),
    "ph_solubility": _closed_sql(acid=f"log10(l_extendedprice * (1 + pow(10::DOUBLE, {_PH} - l_tax * 100)))", base=f"log10(l_extendedprice * (1 + pow(10::DOUBLE, l_tax * 100 - {_PH})))"),
    "buffer_beta": _closed_sql(beta="2.302585092994046::DOUBLE * (1e-14::DOUBLE / pow(10::DOUBLE, -(l_quantity / 5 + 1)) + pow(10::DOUBLE, -(l_quantity / 5 + 1)) + l_tax * pow(10::DOUBLE, -4.76::DOUBLE) * pow(10::DOUBLE, -(l_quantity / 5 + 1)) / pow(pow(10::DOUBLE, -4.76::DOUBLE) + pow(10::DOUBLE, -(l_quantity / 5 + 1)), 2))"),
    "absorption": _closed_sql(
        hia="least(99, greatest(5, 100 - 0.7::DOUBLE * greatest(0, l_quantity * 3 - 60) - 4 * greatest(0, l_linenumber - 3) - 0.05::DOUBLE * greatest(0, l_extendedprice / 150 - 480) - 6 * greatest(0, -1 - l_tax * 50)))",
        log_bb="least(1.2::DOUBLE, greatest(-2, 0.15::DOUBLE + 0.17::DOUBLE * (l_tax * 50) - 0.011::DOUBLE * (l_quantity * 3)))",
        caco2="least(-4, greatest(-7, -4.8::DOUBLE + 0.3::DOUBLE * (l_tax * 50) - 0.008::DOUBLE * (l_quantity * 3)))",
    ),
    "impairment": _closed_sql(ratio=f"1 / ({_F} * (l_discount + 0.2::DOUBLE) + (1 - {_F}) * (l_tax + 0.3::DOUBLE))"),
    "schild": """WITH p AS (SELECT l_suppkey AS agonist, log10(l_quantity / 1e6::DOUBLE) AS x, log10(l_quantity * (1 + l_discount)) AS y FROM lineitem WHERE l_quantity > 0)
SELECT agonist, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_intercept(y, x) / regr_slope(y, x), 6) AS pa2 FROM p GROUP BY agonist HAVING count(*) >= 3""",
}
