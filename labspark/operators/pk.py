"""Closed forms of pharmacokinetics and physical chemistry as column expressions; missing inputs give NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Gas constant in kcal/(mol K), temperature in K, ln 10 and the ion product of water.
GAS, KELVIN, LN10, KW = 1.987204259e-3, 298.15, 2.302585092994046, 1e-14


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x))


def cheng_prusoff(ic50: Column, s: Column, km: Column, modality: str) -> Column:
    """Ki by the mode of inhibition; mixed and unknown modes are not computed."""
    if modality in ("competitive", "radioligand"):
        return ic50 / (1 + s / F.nullif(km, F.lit(0.0)))
    if modality == "noncompetitive":
        return ic50
    if modality == "uncompetitive":
        return ic50 / (1 + km / F.nullif(s, F.lit(0.0)))
    return F.lit(None).cast("double")


def auc_ratio(i: Column, ki: Column, fm: Column, kinact: Column | None = None, kdeg: Column | None = None, induction: Column | None = None) -> Column:
    """Static exposure ratio from reversible inhibition, inactivation (KI = ki) and induction."""
    a = F.lit(1.0) if kinact is None else kdeg / (kdeg + kinact * i / (ki + i))
    b = F.lit(1.0) if induction is None else induction
    return 1 / (a * b * (1 / (1 + i / ki)) * fm + 1 - fm)


def auc_ceiling(fm: Column) -> Column:
    return 1 / F.nullif(1 - fm, F.lit(0.0))


def impairment_ratio(fe: Column, renal: Column, hepatic: Column) -> Column:
    return 1 / F.nullif(fe * renal + (1 - fe) * hepatic, F.lit(0.0))


def bateman(dose: Column, f: Column, v: Column, ka: Column, ke: Column, t: Column) -> Column:
    """One-compartment oral concentration; its limit where ka and ke agree."""
    limit = f * dose * ke * t * F.exp(-ke * t) / v
    return F.when(F.abs(ka - ke) < 1e-9, limit).otherwise(f * dose * ka / (v * F.nullif(ka - ke, F.lit(0.0))) * (F.exp(-ke * t) - F.exp(-ka * t)))


def accumulation(ke: Column, tau: Column) -> Column:
    return 1 / F.nullif(1 - F.exp(-ke * tau), F.lit(0.0))


def delta_g(kd: Column) -> Column:
    """Free energy in kcal/mol of a dissociation constant in mol/L."""
    return GAS * KELVIN * F.ln(kd)


def ligand_efficiency(kd: Column, heavy: Column) -> Column:
    return -delta_g(kd) / F.nullif(heavy, F.lit(0))


def lipophilic_efficiency(p_activity: Column, log_p: Column) -> Column:
    return p_activity - log_p


def lipophilicity_price(le: Column, log_p: Column) -> Column:
    return log_p / F.nullif(le, F.lit(0.0))


def binding_efficiency(p_activity: Column, mw: Column) -> Column:
    return p_activity / (F.nullif(mw, F.lit(0.0)) / 1000)


def surface_efficiency(p_activity: Column, tpsa: Column) -> Column:
    return p_activity / (F.nullif(tpsa, F.lit(0.0)) / 100)


def average_at_steady_state(f: Column, dose: Column, clearance: Column, tau: Column) -> Column:
    return f * dose / F.nullif(clearance * tau, F.lit(0.0))


def basic_inhibition(i: Column, ki: Column) -> Column:
    """R1 (also of the gut, with its own concentration): NULL without a positive Ki."""
    return F.when(ki > 0, 1 + i / ki)


def basic_inactivation(i: Column, ki: Column, kinact: Column, kdeg: Column) -> Column:
    """R2: the enzyme's turnover with inactivation over that without."""
    return 1 + kinact * i / (F.nullif(ki + i, F.lit(0.0)) * F.nullif(kdeg, F.lit(0.0)))


def general_solubility(melting_c: Column, log_p: Column) -> Column:
    """log10 of the aqueous solubility in mol/L by the general solubility equation; liquids have no crystal term."""
    return 0.5 - 0.01 * F.greatest(F.lit(0.0), melting_c - 25) - log_p


def double_reciprocal(s: Column, v: Column) -> tuple[Column, Column]:
    """1/s and 1/v for a Lineweaver-Burk plot, NULL where either is not positive; not for estimating."""
    good = (s > 0) & (v > 0)
    return F.when(good, 1 / s), F.when(good, 1 / v)


def solubility(s0: Column, ph: Column, pka: Column, acid: bool) -> Column:
    return s0 * (1 + F.pow(F.lit(10.0), ph - pka if acid else pka - ph))


def buffer_capacity(ph: Column, c: Column, pka: Column) -> Column:
    """van Slyke capacity of one buffer pair."""
    h, ka = F.pow(F.lit(10.0), -ph), F.pow(F.lit(10.0), -pka)
    return LN10 * (KW / h + h + c * ka * h / F.pow(ka + h, F.lit(2.0)))


# Fixed values in the next three rules: offsets, weights, free ranges and limits of the absorption, brain and Caco-2 estimates.
def intestinal_absorption(tpsa: Column, hbd: Column, mw: Column, log_p: Column) -> Column:
    over = lambda x, limit: F.greatest(F.lit(0.0), x - limit)
    return _clamp(100 - 0.7 * over(tpsa, 60.0) - 4 * over(hbd, 3.0) - 0.05 * over(mw, 480.0) - 6 * F.greatest(F.lit(0.0), -1 - log_p), 5, 99)


def log_bb(log_p: Column, tpsa: Column) -> Column:
    return _clamp(0.15 + 0.17 * log_p - 0.011 * tpsa, -2, 1.2)


def caco2(log_p: Column, tpsa: Column) -> Column:
    return _clamp(-4.8 + 0.3 * log_p - 0.008 * tpsa, -7, -4)


def occupancy(cu: Column, kd: Column) -> Column:
    return cu / (kd + cu)


def time_above(series: DataFrame, kd: float) -> DataFrame:
    """hours_above by subject: time at half occupancy or more (c >= kd), crossings interpolated linearly."""
    by = Window.partitionBy("subject").orderBy("t")
    rows = series.withColumn("t1", F.lead("t").over(by)).withColumn("c1", F.lead("c").over(by))
    dt, c, c1 = F.col("t1") - F.col("t"), F.col("c"), F.col("c1")
    part = F.when(c1.isNull(), 0.0).when((c >= kd) & (c1 >= kd), dt).when(c >= kd, dt * (c - kd) / F.nullif(c - c1, F.lit(0.0))).when(c1 >= kd, dt * (c1 - kd) / F.nullif(c1 - c, F.lit(0.0))).otherwise(0.0)
    return rows.groupBy("subject").agg(F.sum(part).alias("hours_above"))


def schild(points: DataFrame, key: str) -> DataFrame:
    """n, slope, intercept and pA2 of log(DR - 1) against log[B] by key; three points at least."""
    fit = points.groupBy(key).agg(F.count("*").alias("n"), F.regr_slope("log_dr1", "log_b").alias("slope"), F.regr_intercept("log_dr1", "log_b").alias("intercept"))
    return fit.filter("n >= 3").withColumn("pa2", F.col("intercept") / F.nullif(F.col("slope"), F.lit(0.0)))


# Intrinsic clearance that a group is assumed to add, in multiples of hepatic flow, with the route it
# stands for; the first group that a compound has names the limiting route. A phenol counts without a catechol alone.
FIRST_PASS = (
    ("catechol", 15.0, "catechol conjugation and deamination"), ("ester", 2.2, "ester hydrolysis"), ("mao_amine", 2.5, "amine deamination"),
    ("aryl_ketone", 0.9, "carbonyl reduction"), ("phenol", 0.3, "phenol conjugation"),
)
FIRST_PASS_BASE, FIRST_PASS_PER_LOG_P = 0.05, 0.08


def hepatic_availability(hia: Column, log_p: Column, groups: dict[str, Column], flow: float, measured: Column | None = None) -> dict[str, Column]:
    """clint (unbound, L/h), first_pass (share surviving), clearance (L/h), oral (percent) and route, by the well-stirred liver.

    Without a measured intrinsic clearance one is assumed from groups (booleans by the names
    in FIRST_PASS; a null counts as absent) and log P, which ranks compounds and measures
    nothing. hia is the absorbed percent. A flow of 0 or less gives NULLs.
    """
    has = {name: F.coalesce(groups[name], F.lit(False)) for name, _, _ in FIRST_PASS}
    has["phenol"] = has["phenol"] & ~has["catechol"]
    relative = F.lit(FIRST_PASS_BASE) + FIRST_PASS_PER_LOG_P * F.greatest(F.lit(0.0), log_p - 2)
    route = F.lit("little first-pass metabolism")
    for name, weight, told in reversed(FIRST_PASS):
        relative = relative + F.when(has[name], weight).otherwise(0.0)
        route = F.when(has[name], told).otherwise(route)
    given = F.lit(None).cast("double") if measured is None else F.when(measured >= 0, measured)
    q = F.lit(float(flow) if flow > 0 else None).cast("double")
    clint = F.coalesce(given, relative * q) + 0 * q
    first = q / (q + clint)
    oral = F.when(q.isNotNull(), _clamp(hia * first, 1, 99))
    route = F.when(q.isNull(), "no hepatic flow").when(given.isNotNull(), "measured intrinsic clearance").otherwise(route)
    return {"clint": clint, "first_pass": first, "clearance": clint * first, "oral": oral, "route": route}


# Fixed values in the next two rules: limits of efflux substrates and of compounds that reach the brain.
def efflux_substrate(mw: Column, hba: Column, tpsa: Column) -> Column:
    return ((mw > 400) & (hba >= 6)) | (tpsa > 120)


def reaches_brain(log_p: Column, tpsa: Column, mw: Column) -> Column:
    return (log_bb(log_p, tpsa) > -0.3) & (tpsa < 90) & (mw < 450)
