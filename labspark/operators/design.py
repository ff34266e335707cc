"""Assay design and signal processing: dilutions, optimal ladders, simulated plates, derivatives, p-values, balances."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add, or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labspark.kernels import fit, special


def stock_mass(molar: Column, litres: Column, weight: Column, purity: Column) -> Column:
    """Grams to weigh in."""
    return molar * litres * weight / F.nullif(purity, F.lit(0.0))


def serial_dilution(spark: SparkSession, top: float, factor: float, steps: int) -> DataFrame:
    """step and conc of a ladder that falls by factor."""
    if factor <= 1 or steps < 1 or top <= 0:
        raise ValueError("a ladder has a positive top, a factor over 1 and a step")
    return spark.range(steps).select(F.col("id").cast("int").alias("step"), (F.lit(top) / F.pow(F.lit(float(factor)), F.col("id"))).alias("conc"))


def d_optimal(candidates: np.ndarray, truth: np.ndarray, points: int) -> tuple[np.ndarray, float]:
    """Concentrations by exchange that maximise the information determinant of a four-parameter curve, and its log."""
    x = np.log10(np.asarray(candidates, float))
    rows = fit.jacobian(fit.logistic4, x, np.asarray(truth, float))
    chosen = list(np.linspace(0, len(x) - 1, points).round().astype(int))
    score = lambda idx: np.linalg.slogdet(rows[idx].T @ rows[idx] + 1e-12 * np.eye(4))[1]
    best = score(chosen)
    while True:
        moves = [(score(chosen[:i] + [j] + chosen[i + 1 :]), i, j) for i in range(points) for j in range(len(x))]
        top = max(moves)
        if top[0] <= best + 1e-9:
            return np.sort(np.asarray(candidates, float)[chosen])[::-1], float(best)
        best = top[0]
        chosen[top[1]] = top[2]


def simulate_fits(spark: SparkSession, conc: list[float], truth: list[float], sd: float, runs: int, seed: int) -> DataFrame:
    """run, log_ec50, error and covered (the truth within 95 %) of simulated curves; each run has its own stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, p = np.array(conc), np.array(truth)
        clean = fit.logistic4(np.log10(c), p)
        for batch in batches:
            rows = []
            for r in batch["id"]:
                got = fit.fit_4pl(c, clean + np.random.default_rng([seed, int(r)]).normal(0, sd, len(c)))
                error = float(got.errors[2]) if got.errors is not None else None
                # Student's quantile at 97.5 % by its expansion in the normal one.
                df = len(c) - 4
                t = 1.959964 + (1.959964**3 + 1.959964) / (4 * df) + (5 * 1.959964**5 + 16 * 1.959964**3 + 3 * 1.959964) / (96 * df * df)
                rows.append((int(r), float(got.params[2]), error, None if error is None else bool(abs(got.params[2] - p[2]) <= t * error)))
            yield pd.DataFrame(rows, columns=["run", "log_ec50", "error", "covered"])

    return spark.range(runs).repartition(2 * spark.sparkContext.defaultParallelism).mapInPandas(run, "run long, log_ec50 double, error double, covered boolean")


def savitzky_golay(series: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """series with dy: the first derivative by a quadratic over nine points; NULL near the ends.

    A group whose spacing varies by more than 5 % gets no derivative.
    """
    by = Window.partitionBy(group).orderBy(x)
    step = F.col(x) - F.lag(x).over(by)
    rows = series.withColumn("step", step)
    whole = Window.partitionBy(group)
    even = F.coalesce(F.stddev_samp("step").over(whole), F.lit(0.0)) <= 0.05 * F.avg("step").over(whole)
    slope = sum((F.lit(k / 60.0) * (F.lead(y, k).over(by) - F.lag(y, k).over(by)) for k in range(2, 5)), F.lit(1 / 60.0) * (F.lead(y, 1).over(by) - F.lag(y, 1).over(by)))
    return rows.withColumn("dy", F.when(even, slope / F.avg("step").over(whole))).drop("step")


def p_two_sided(z: Column) -> Column:
    """Two-sided normal tail of a non-negative z."""

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if pd.isna(x) else special.normal_two_sided(float(x))).astype("float64")

    return run(z)


def p_chi2(h: Column, df: Column) -> Column:
    """Upper chi-square tail."""

    @F.pandas_udf("double")
    def run(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) or b < 1 else special.chi2_survival(float(a), int(b)) for a, b in zip(x, k, strict=True)], dtype="float64")

    return run(h, df)


def element_balance(terms: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """reaction, unbalanced (elements) and missing of (reaction, coefficient, composition map or NULL) terms.

    Products have positive coefficients. A term without composition counts as missing, and
    its reaction as unbalanced.
    """
    spread = terms.select("reaction", "coefficient", F.explode_outer("composition").alias("element", "n"))
    sums = spread.filter("element IS NOT NULL").groupBy("reaction", "element").agg(F.sum(F.col("coefficient") * F.col("n")).alias("net"))
    off = sums.groupBy("reaction").agg(F.sort_array(F.collect_list(F.when(F.abs("net") > tolerance, F.col("element")))).alias("unbalanced"))
    missing = terms.groupBy("reaction").agg(F.sum(F.col("composition").isNull().cast("int")).alias("missing"))
    return missing.join(off, "reaction", "left").select("reaction", F.coalesce("unbalanced", F.array().cast("array<string>")).alias("unbalanced"), "missing", ((F.col("missing") == 0) & (F.size(F.coalesce("unbalanced", F.array().cast("array<string>"))) == 0)).alias("balanced"))


def shelf_life(k: Column, start: Column, limit: Column, order: int = 1) -> Column:
    """Time until start has fallen to limit by zero- or first-order loss; NULL where it never does."""
    life = (start - limit) / F.nullif(k, F.lit(0.0)) if order == 0 else F.ln(start / F.nullif(limit, F.lit(0.0))) / F.nullif(k, F.lit(0.0))
    return F.when((k > 0) & (limit > 0) & (start >= limit), life)


# Resistance scores by the first group that a compound has, the last for compounds without any.
STABILITY = {
    "hydrolysis": ((("ester",), 34.0), (("amide",), 70.0), ((), 92.0)),
    "oxidation": ((("catechol",), 22.0), (("phenol",), 58.0), (("lipophilic",), 76.0), ((), 85.0)),
    "photolysis": ((("catechol", "aryl_ketone"), 54.0), ((), 82.0)),
    "thermal": ((("aryl_ketone",), 66.0), (("ester",), 72.0), ((), 88.0)),
    "ph": ((("ester", "aryl_ketone", "catechol"), 58.0), ((), 80.0)),
}


def stability(groups: dict[str, Column], log_p: Column) -> dict[str, Column]:
    """Five resistance scores and their mean (overall): a rank order without a unit, no stability study.

    groups has a boolean column for ester, amide, catechol, phenol and aryl_ketone; a null
    counts as absent. A compound is lipophilic from a log P over 2.
    """
    has = {name: F.coalesce(c, F.lit(False)) for name, c in (groups | {"lipophilic": log_p > 2}).items()}
    scores = {}
    for factor, rules in STABILITY.items():
        score = F.lit(rules[-1][1])
        for names, value in reversed(rules[:-1]):
            score = F.when(reduce(or_, (has[n] for n in names)), value).otherwise(score)
        scores[factor] = score
    return scores | {"overall": reduce(add, scores.values()) / len(scores)}


def precipitation_rate(series: DataFrame, key: str, solubility: float) -> DataFrame:
    """n, rate (1/time), its standard error and what is missing, from the decay of concentrations c over t to solubility.

    The logarithm of the excess is linear in time; points at or below solubility tell nothing
    and are left out. Two points fit exactly, with an error of 0.
    """
    y, t = F.ln(F.col("c") - solubility), F.col("t")
    rows = series.withColumn("y", F.when(F.col("c") > solubility, y)).withColumn("x", F.when(F.col("y").isNotNull(), t))
    fit = rows.groupBy(key).agg(F.regr_count("y", "x").alias("n"), F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy"), F.regr_syy("y", "x").alias("syy"))
    n, sxx, sxy = F.col("n"), F.col("sxx"), F.col("sxy")
    slope = F.when((n >= 2) & (sxx > 0), sxy / sxx)
    reason = F.when(n < 2, "two supersaturated observations").when(~(sxx > 0), "two distinct times").when(slope >= 0, "a decay")
    rest = F.greatest(F.col("syy") - sxy * sxy / sxx, F.lit(0.0))
    error = F.when(n > 2, F.sqrt(rest / (n - 2) / sxx)).otherwise(0.0)
    return fit.select(key, "n", F.when(reason.isNull(), -slope).alias("rate"), F.when(reason.isNull(), error).alias("error"), reason.alias("missing"))
