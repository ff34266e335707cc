"""Plate assays: role statistics, quality control, normalisation, outliers and rank tests.

Wells carry plate, role ('positive', 'negative', 'blank' or 'sample'), value and excluded.
Excluded wells and NULL values take no part in statistics but keep their rows. A figure
whose prerequisite is missing is NULL, and where a report has a refusal, it names the cause.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labspark.functions.stats import MAD_SCALE, cv_percent, sem

# Two-sided Grubbs critical values at alpha 0.05 for n = 3 to 30.
GRUBBS = (1.1543, 1.4812, 1.7150, 1.8871, 2.0200, 2.1266, 2.2150, 2.2900, 2.3547, 2.4116, 2.4620, 2.5073, 2.5483, 2.5857, 2.6200, 2.6516, 2.6809, 2.7082, 2.7337, 2.7576, 2.7801, 2.8013, 2.8214, 2.8404, 2.8586, 2.8759, 2.8924, 2.9082)
# Dixon Q critical values at 95 % for n = 3 to 10.
DIXON = (0.970, 0.829, 0.710, 0.625, 0.568, 0.526, 0.493, 0.466)


def included(wells: DataFrame) -> DataFrame:
    return wells.filter(~F.coalesce(F.col("excluded"), F.lit(False)) & F.col("value").isNotNull())


def with_mad(rows: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    """median and mad of value by keys: the second pass is over distances from the first's median."""
    med = rows.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("median"))
    both = rows.join(med, list(keys)).withColumn("distance", F.abs(F.col(value) - F.col("median")))
    return both.groupBy(*keys).agg(F.first("median").alias("median"), F.percentile("distance", F.lit(0.5)).alias("mad"))


def role_stats(wells: DataFrame) -> DataFrame:
    """n, mean, sd, sem, cv, median, mad and robust sd by plate and role."""
    rows = included(wells)
    x = F.col("value")
    moments = rows.groupBy("plate", "role").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), sem(x).alias("sem"), cv_percent(x).alias("cv"))
    return moments.join(with_mad(rows, "plate", "role"), ["plate", "role"]).withColumn("robust_sd", F.col("mad") * MAD_SCALE)


def plate_qc(wells: DataFrame) -> DataFrame:
    """Z', robust Z', SSMD, signal to background and to noise, and the blank-subtracted sd per plate.

    One shuffle on the plate carries the moments, a second the absolute deviations.
    """
    of = lambda role, x=F.col("value"): F.when(F.col("role") == role, x)
    pos, neg, blank = of("positive"), of("negative"), of("blank")
    rows = included(wells)
    half = F.lit(0.5)
    stats = rows.groupBy("plate").agg(
        F.count(pos).alias("n_pos"), F.count(neg).alias("n_neg"), F.count(blank).alias("n_blank"),
        F.avg(pos).alias("mean_pos"), F.avg(neg).alias("mean_neg"), F.avg(blank).alias("mean_blank"),
        F.stddev_samp(pos).alias("sd_pos"), F.stddev_samp(neg).alias("sd_neg"), F.stddev_samp(blank).alias("sd_blank"),
        F.percentile(pos, half).alias("median_pos"), F.percentile(neg, half).alias("median_neg"),
    )
    spread = rows.join(stats.select("plate", "median_pos", "median_neg"), "plate").groupBy("plate").agg(
        F.percentile(of("positive", F.abs(F.col("value") - F.col("median_pos"))), half).alias("mad_pos"),
        F.percentile(of("negative", F.abs(F.col("value") - F.col("median_neg"))), half).alias("mad_neg"),
    )
    enough = (F.col("n_pos") >= 2) & (F.col("n_neg") >= 2)
    gap, median_gap = F.abs(F.col("mean_pos") - F.col("mean_neg")), F.abs(F.col("median_pos") - F.col("median_neg"))
    both = F.sqrt(F.col("sd_pos") * F.col("sd_pos") + F.col("sd_neg") * F.col("sd_neg"))
    return stats.join(spread, "plate").select(
        "plate", "n_pos", "n_neg", "mean_pos", "mean_neg", "sd_pos", "sd_neg",
        F.when(enough & (gap > 0), 1 - 3 * (F.col("sd_pos") + F.col("sd_neg")) / gap).alias("z_prime"),
        F.when(enough & (median_gap > 0), 1 - 3 * MAD_SCALE * (F.col("mad_pos") + F.col("mad_neg")) / median_gap).alias("robust_z_prime"),
        F.when(enough & (both > 0), (F.col("mean_pos") - F.col("mean_neg")) / both).alias("ssmd"),
        F.when(F.col("mean_neg") != 0, F.col("mean_pos") / F.col("mean_neg")).alias("signal_to_background"),
        F.when(enough & (F.col("sd_neg") > 0), (F.col("mean_pos") - F.col("mean_neg")) / F.col("sd_neg")).alias("signal_to_noise"),
        F.when((F.col("n_blank") >= 2) & (F.col("n_pos") >= 2), F.col("sd_pos") * F.col("sd_pos") + F.col("sd_blank") * F.col("sd_blank") / F.col("n_blank")).alias("blank_variance"),
        F.when(F.col("n_pos") < 2, "fewer than two positive controls").when(F.col("n_neg") < 2, "fewer than two negative controls").when(gap == 0, "controls do not separate").alias("refusal"),
    )


def normalise(wells: DataFrame) -> DataFrame:
    """Every well with percent of control, NPI, z and robust z; statistics from included wells alone.

    z and robust z refer to the plate's included samples. The statistics are a row per plate
    and join back on it.
    """
    rows = included(wells)
    of = lambda role: F.when(F.col("role") == role, F.col("value"))
    stats = rows.groupBy("plate").agg(F.avg(of("positive")).alias("mean_pos"), F.avg(of("negative")).alias("mean_neg"), F.avg(of("sample")).alias("mean"), F.stddev_samp(of("sample")).alias("sd"))
    robust = with_mad(rows.filter("role = 'sample'"), "plate")
    x = F.col("value")
    return wells.join(stats, "plate", "left").join(robust, "plate", "left").select(
        *wells.columns,
        F.when(F.col("mean_neg") != 0, 100 * x / F.col("mean_neg")).alias("poc"),
        F.when(F.col("mean_neg") != F.col("mean_pos"), 100 * (F.col("mean_neg") - x) / (F.col("mean_neg") - F.col("mean_pos"))).alias("npi"),
        F.when(F.col("sd") > 0, (x - F.col("mean")) / F.col("sd")).alias("z"),
        F.when(F.col("mad") > 0, (x - F.col("median")) / (F.col("mad") * MAD_SCALE)).alias("robust_z"),
    )


def _critical(n: Column, table: tuple[float, ...], first: int = 3) -> Column:
    """The table's value for n; NULL outside it."""
    return F.when((n >= first) & (n < first + len(table)), F.get(F.array(*(F.lit(v) for v in table)), (n - first).cast("int")))


def grubbs(rows: DataFrame, group: str, value: str = "value") -> DataFrame:
    """n, statistic, critical, flagged and the suspect value by group; n of 3 to 30, else NULLs. Single pass."""
    stats = rows.filter(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"))
    high_side = F.col("high") - F.col("mean") >= F.col("mean") - F.col("low")
    far = F.greatest(F.col("high") - F.col("mean"), F.col("mean") - F.col("low"))
    g = F.when((F.col("sd") > 0) & _critical(F.col("n"), GRUBBS).isNotNull(), far / F.col("sd"))
    return stats.select(group, "n", g.alias("statistic"), _critical(F.col("n"), GRUBBS).alias("critical"), F.when(high_side, F.col("high")).otherwise(F.col("low")).alias("suspect")).withColumn("flagged", F.coalesce(F.col("statistic") > F.col("critical"), F.lit(False)))


def dixon(rows: DataFrame, group: str, value: str = "value") -> DataFrame:
    """Q at both ends by group, for n of 3 to 10; the two smallest and largest come from bounded top lists."""
    own = rows.filter(F.col(value).isNotNull())
    up = F.row_number().over(Window.partitionBy(group).orderBy(value))
    down = F.row_number().over(Window.partitionBy(group).orderBy(F.col(value).desc()))
    ranked = own.select(group, value, up.alias("up"), down.alias("down"))
    at = lambda c, k: F.max(F.when(F.col(c) == k, F.col(value)))
    ends = ranked.groupBy(group).agg(F.count("*").alias("n"), at("up", 1).alias("x1"), at("up", 2).alias("x2"), at("down", 2).alias("y2"), at("down", 1).alias("y1"))
    critical, span = _critical(F.col("n"), DIXON), F.col("y1") - F.col("x1")
    ok = critical.isNotNull() & (span > 0)
    return ends.select(group, "n", F.when(ok, (F.col("x2") - F.col("x1")) / span).alias("q_low"), F.when(ok, (F.col("y1") - F.col("y2")) / span).alias("q_high"), critical.alias("critical")).withColumn(
        "flagged", F.coalesce(F.greatest("q_low", "q_high") > F.col("critical"), F.lit(False))
    )


def _quartile(low: Column, high: Column, share: Column) -> Column:
    """low * (1 - share) + high * share, the first product not rounded (fused), as DuckDB's quantile_cont has it.

    Readouts are often multiples of a step and lie on the fences themselves, where the last digit decides.
    """
    fused = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), low, 1 - share, high * share).cast("double")
    return F.when(share > 0, fused).otherwise(low)


def tukey_fences(rows: DataFrame, group: str, value: str = "value") -> DataFrame:
    """Quartiles (type 7), fences and the number of values outside them; needs n >= 4 and a positive IQR.

    Equal values of a group are counted before they are ranked, and the counts serve both steps.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("x")).agg(F.count("*").alias("times"))
    by = Window.partitionBy(group)
    ranked = counts.withColumn("n", F.sum("times").over(by)).withColumn("upto", F.sum("times").over(by.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))

    def at(place: Column) -> Column:
        return F.max(F.when((place < F.col("upto")) & (place >= F.col("upto") - F.col("times")), F.col("x")))

    place = {k: (F.col("n") - 1) * p for k, p in (("q1", 0.25), ("q3", 0.75))}
    ends = ranked.groupBy(group, "n").agg(*(at(f(place[k])).alias(f"{k}_{side}") for k in place for side, f in (("low", F.floor), ("high", F.ceil))))
    q = ends.select(group, "n", *(_quartile(F.col(f"{k}_low"), F.col(f"{k}_high"), place[k] - F.floor(place[k])).alias(k) for k in place))
    iqr = F.col("q3") - F.col("q1")
    ok = (F.col("n") >= 4) & (iqr > 0)
    q = q.withColumn("low_fence", F.when(ok, F.col("q1") - 1.5 * iqr)).withColumn("high_fence", F.when(ok, F.col("q3") + 1.5 * iqr))
    outside = F.coalesce((F.col("x") < F.col("low_fence")) | (F.col("x") > F.col("high_fence")), F.lit(False))
    return counts.join(q, group).groupBy(group, "n", "q1", "q3", "low_fence", "high_fence").agg(F.sum(F.when(outside, F.col("times")).otherwise(0)).alias("n_outside"))


def mid_ranks(rows: DataFrame, group: str, value: str = "value") -> DataFrame:
    """rows with rank (the mean rank of ties) and ties (their number) of value within group."""
    by = Window.partitionBy(group).orderBy(value)
    same = F.count("*").over(Window.partitionBy(group, value))
    return rows.withColumn("ties", same).withColumn("rank", F.rank().over(by) + (F.col("ties") - 1) / 2)


def mann_whitney(rows: DataFrame, group: str, first: Column, value: str = "value") -> DataFrame:
    """n1, n2, U and z (tie- and continuity-corrected) of the rows where first holds against the others."""
    ranked = mid_ranks(rows.filter(F.col(value).isNotNull()).withColumn("first", first), group, value)
    s = ranked.groupBy(group).agg(
        F.sum(F.col("first").cast("long")).alias("n1"), F.sum((~F.col("first")).cast("long")).alias("n2"),
        F.sum(F.when(F.col("first"), F.col("rank"))).alias("r1"), F.sum((F.col("ties") * F.col("ties") - 1).cast("double")).alias("tie_sum"),
    )
    n1, n2, n = F.col("n1").cast("double"), F.col("n2").cast("double"), (F.col("n1") + F.col("n2")).cast("double")
    u = n1 * n2 + n1 * (n1 + 1) / 2 - F.col("r1")
    variance = n1 * n2 / 12 * ((n + 1) - F.col("tie_sum") / (n * (n - 1)))
    ok = (F.col("n1") > 0) & (F.col("n2") > 0) & (n > 1)
    s = s.select(group, "n1", "n2", F.when(ok, u).alias("u"), F.when(ok, variance).alias("variance"))
    return s.select(group, "n1", "n2", "u", F.when(F.col("variance") > 0, F.greatest(F.lit(0.0), (F.abs(F.col("u") - n1 * n2 / 2) - 0.5) / F.sqrt("variance"))).alias("z"))


def kruskal_wallis(rows: DataFrame, group: str, level: str, value: str = "value") -> DataFrame:
    """k, n and the tie-corrected H over the levels of each group; levels under two values are left out."""
    size = F.count("*").over(Window.partitionBy(group, level))
    ranked = mid_ranks(rows.filter(F.col(value).isNotNull()).withColumn("size", size).filter("size >= 2"), group, value)
    by_level = ranked.groupBy(group, level).agg(F.sum("rank").alias("r"), F.count("*").alias("n"), F.sum((F.col("ties") * F.col("ties") - 1).cast("double")).alias("tie_sum"))
    s = by_level.groupBy(group).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.sum("tie_sum").alias("tie_sum"))
    n = F.col("n").cast("double")
    correction = 1 - F.col("tie_sum") / (n * n * n - n)
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / correction
    return s.select(group, "k", "n", F.when((F.col("k") >= 2) & (correction > 0), h).alias("h"))


def replicate_sd(wells: DataFrame) -> DataFrame:
    """n and sample sd of the wells of each plate and concentration; a single well has no sd, which is NULL and not 0."""
    rows = included(wells)
    return rows.groupBy("plate", "conc").agg(F.count("*").alias("n"), F.stddev_samp("value").alias("sd"))
