"""Noncompartmental analysis of concentration series (subject, t, c) by ordered windows.

Series are partitioned by subject, so one shuffle serves all of it. A subject whose times
do not increase strictly has a refusal and no figures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _segments(series: DataFrame) -> DataFrame:
    by = Window.partitionBy("subject").orderBy("t")
    return series.withColumn("t0", F.lag("t").over(by)).withColumn("c0", F.lag("c").over(by))


def auc_segments(series: DataFrame) -> DataFrame:
    """series with auc and aumc of the segment that ends at each point: linear up, logarithmic down."""
    rows = _segments(series)
    dt, c0, c1, t0, t1 = F.col("t") - F.col("t0"), F.col("c0"), F.col("c"), F.col("t0"), F.col("t")
    falls = (c1 < c0) & (c1 > 0) & (c0 > 0)
    ratio = F.when(falls, F.ln(c0 / c1))
    auc = F.when(falls, dt * (c0 - c1) / ratio).otherwise(dt * (c0 + c1) / 2)
    aumc = F.when(falls, dt * (t0 * c0 - t1 * c1) / ratio + dt * dt * (c0 - c1) / (ratio * ratio)).otherwise(dt * (t0 * c0 + t1 * c1) / 2)
    return rows.withColumn("auc", auc).withColumn("aumc", aumc)


def exposure(series: DataFrame) -> DataFrame:
    """n, auc_last, aumc_last, t_last and whether times increase, by subject."""
    return auc_segments(series).groupBy("subject").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("auc"), F.lit(0.0)).alias("auc_last"), F.coalesce(F.sum("aumc"), F.lit(0.0)).alias("aumc_last"),
        F.max("t").alias("t_last"), F.coalesce(F.min(F.col("t") > F.col("t0")), F.lit(True)).alias("increasing"),
    )


def peaks(series: DataFrame) -> DataFrame:
    """cmax and tmax (its first time) by subject."""
    return series.groupBy("subject").agg(F.max("c").alias("cmax"), F.max_by("t", F.struct(F.col("c"), -F.col("t"))).alias("tmax"))


def lambda_z(series: DataFrame) -> DataFrame:
    """lambda_z, intercept, n_points, adj_r2 and start by subject.

    Every window of positive points from some time after tmax to the end, of three or more
    points and falling, is a candidate; the best adjusted R^2 wins, the earliest start among
    equals. Sums run backwards from the end, so all windows take one pass.
    """
    after = series.join(peaks(series).select("subject", "tmax"), "subject").filter((F.col("t") > F.col("tmax")) & (F.col("c") > 0))
    y = F.ln("c")
    tail = Window.partitionBy("subject").orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = Window.partitionBy("subject")
    # Centred on the subject's means, the running sums keep their digits.
    rows = after.withColumn("y", y).withColumn("mt", F.avg("t").over(middle)).withColumn("my", F.avg("y").over(middle))
    x, v = F.col("t") - F.col("mt"), F.col("y") - F.col("my")
    sums = {"k": F.count("*"), "sx": F.sum(x), "sy": F.sum(v), "sxx": F.sum(x * x), "sxy": F.sum(x * v), "syy": F.sum(v * v)}
    rows = rows.withColumns({k: s.over(tail) for k, s in sums.items()})
    k = F.col("k").cast("double")
    dx, dy, dxy = F.col("sxx") - F.col("sx") * F.col("sx") / k, F.col("syy") - F.col("sy") * F.col("sy") / k, F.col("sxy") - F.col("sx") * F.col("sy") / k
    rows = rows.withColumn("slope", F.when((F.col("k") >= 3) & (dx > 0), dxy / dx)).withColumn("r2", F.when((dx > 0) & (dy > 0), dxy * dxy / (dx * dy)))
    rows = rows.withColumn("adj_r2", 1 - (1 - F.col("r2")) * (k - 1) / F.nullif(k - 2, F.lit(0.0)))
    good = rows.filter((F.col("slope") < 0) & F.col("adj_r2").isNotNull())
    level = F.col("my") + F.col("sy") / k - F.col("slope") * (F.col("sx") / k + F.col("mt"))
    best = F.max_by(F.struct((-F.col("slope")).alias("lambda_z"), level.alias("intercept"), F.col("k").alias("n_points"), "adj_r2", F.col("t").alias("start")), F.struct(F.round("adj_r2", 12), -F.col("t")))
    return good.groupBy("subject").agg(best.alias("b")).select("subject", "b.*")


def nca(series: DataFrame, dose: float, route: str = "iv") -> DataFrame:
    """The full report by subject: extrapolated exposure, half-life, clearance, volumes and residence time.

    Without a terminal slope everything that needs one is NULL, and refusal says so.
    """
    rows = exposure(series).join(peaks(series), "subject").join(lambda_z(series), "subject", "left")
    last = F.exp(F.col("intercept") - F.col("lambda_z") * F.col("t_last"))
    ok = F.col("increasing") & F.col("lambda_z").isNotNull()
    given = lambda c: F.when(ok, c)
    rows = rows.withColumn("c_last", given(last)).withColumn("auc_inf", given(F.col("auc_last") + last / F.col("lambda_z")))
    rows = rows.withColumn("aumc_inf", given(F.col("aumc_last") + F.col("t_last") * last / F.col("lambda_z") + last / (F.col("lambda_z") * F.col("lambda_z"))))
    cl, mrt = F.lit(float(dose)) / F.col("auc_inf"), F.col("aumc_inf") / F.col("auc_inf")
    return rows.select(
        "subject", "n", "cmax", "tmax", F.when(F.col("increasing"), F.col("auc_last")).alias("auc_last"), "lambda_z", "n_points", "auc_inf",
        (100 * (F.col("auc_inf") - F.col("auc_last")) / F.col("auc_inf")).alias("percent_extrapolated"),
        given(F.lit(0.6931471805599453) / F.col("lambda_z")).alias("half_life"), cl.alias("clearance"), (cl / F.col("lambda_z")).alias("vz"), mrt.alias("mrt"),
        (cl * mrt if route == "iv" else F.lit(None).cast("double")).alias("vss"),
        F.when(~F.col("increasing"), "times do not increase").when(F.col("lambda_z").isNull(), "no terminal slope").alias("refusal"),
    )


def bands(series: DataFrame, at: Column) -> DataFrame:
    """5th, 50th and 95th percentiles of c (type 7) by time bin."""
    p = F.percentile("c", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return series.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), p.alias("p")).select("bin", "n", F.col("p")[0].alias("p5"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p95"))


def exposure_summary(series: DataFrame) -> DataFrame:
    """n, median AUC and Cmax over all subjects, and the AUC's coefficient of variation in percent.

    The variation needs more than one subject and a positive mean; else it is NULL.
    """
    both = exposure(series).join(peaks(series), "subject")
    mean = F.avg("auc_last")
    cv = F.when((F.count("*") > 1) & (mean > 0), 100 * F.stddev_samp("auc_last") / mean)
    return both.agg(F.count("*").alias("n"), F.percentile("auc_last", F.lit(0.5)).alias("median_auc"), F.percentile("cmax", F.lit(0.5)).alias("median_cmax"), cv.alias("auc_cv"))


def dosing_interval(series: DataFrame, tau: float) -> DataFrame:
    """auc_tau, c_average and swing by subject at steady state, from the samples up to tau.

    Without an area over the interval all three are NULL; without a positive trough swing is.
    """
    inside = F.col("t") <= tau
    found = auc_segments(series).groupBy("subject").agg(F.sum(F.when(inside, F.col("auc"))).alias("area"), F.min(F.when(inside, F.col("c"))).alias("trough"), F.max("c").alias("cmax"))
    area = F.when(F.col("area") > 0, F.col("area"))
    swing = F.when(area.isNotNull() & (F.col("trough") > 0), (F.col("cmax") - F.col("trough")) / F.col("trough"))
    return found.select("subject", area.alias("auc_tau"), (area / tau).alias("c_average"), swing.alias("swing"))
