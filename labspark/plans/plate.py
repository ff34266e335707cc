"""Plate queries over the wells view."""

from __future__ import annotations

from pyspark.sql import functions as F

from labspark.operators import assay
from labspark.plans.views import WELLS, rounded, wells
from labspark.tables import table

QC = ("mean_pos", "mean_neg", "sd_pos", "sd_neg", "z_prime", "robust_z_prime", "ssmd", "signal_to_background", "signal_to_noise", "blank_variance")


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("value"))


def _edge(spark, sf_dir):
    ring = F.col("row").isin(0, 7) | F.col("col").isin(0, 11)
    return rounded(assay.mann_whitney(assay.included(wells(spark, sf_dir)), "plate", ring), "u", "z")


def _fences(spark, sf_dir):
    """Rounded as the SQL rounds: a fence that rounds to zero from below is a negative zero."""
    signed = lambda c: F.when((F.round(c, 6) == 0) & (F.col(c) < 0), F.lit(-0.0)).otherwise(F.round(c, 6))
    return assay.tukey_fences(assay.included(wells(spark, sf_dir)), "plate").withColumns({c: signed(c) for c in ("q1", "q3", "low_fence", "high_fence")})


def _norm(column):
    def query(spark, sf_dir):
        got = assay.normalise(wells(spark, sf_dir)).select("plate", "well_order", "well_line", "role", "excluded", F.col(column).alias("normalised"))
        return rounded(got, "normalised")

    return query


QUERIES = {
    "plate_qc": lambda s, d: rounded(assay.plate_qc(wells(s, d)), *QC),
    "role_stats": lambda s, d: rounded(assay.role_stats(wells(s, d)), "mean", "sd", "sem", "cv", "median", "mad", "robust_sd"),
    "norm_poc": _norm("poc"),
    "norm_npi": _norm("npi"),
    "norm_z": _norm("z"),
    "norm_robust_z": _norm("robust_z"),
    "grubbs": lambda s, d: rounded(assay.grubbs(_orders(s, d), "l_orderkey"), "statistic"),
    "dixon": lambda s, d: rounded(assay.dixon(_orders(s, d), "l_orderkey"), "q_low", "q_high"),
    "tukey_fences": _fences,
    "mann_whitney_z": _edge,
    "kruskal_h": lambda s, d: rounded(assay.kruskal_wallis(assay.included(wells(s, d)), "plate", "col"), "h"),
}

IN = "SELECT * FROM wells WHERE NOT excluded AND value IS NOT NULL"
_K = "1.4826022185056018::DOUBLE"


def _values(table_):
    return "crit(n, critical) AS (VALUES " + ", ".join(f"({i + 3}, {v!r}::DOUBLE)" for i, v in enumerate(table_)) + ")"


def _norm_sql(expr):
    return f"""WITH {WELLS}, stats AS (
  SELECT plate, avg(value) FILTER (role = 'positive') AS mp, avg(value) FILTER (role = 'negative') AS mn, avg(value) FILTER (role = 'sample') AS m,
    stddev_samp(value) FILTER (role = 'sample') AS sd, median(value) FILTER (role = 'sample') AS med, mad(value) FILTER (role = 'sample') AS mad
  FROM ({IN}) GROUP BY plate)
SELECT plate, well_order, well_line, role, excluded, round({expr}, 6) + 0.0::DOUBLE AS normalised FROM wells LEFT JOIN stats USING (plate)"""


ORACLES = {
    "plate_qc": f"""WITH {WELLS}, s AS (
  SELECT plate, count(*) FILTER (role = 'positive') AS n_pos, count(*) FILTER (role = 'negative') AS n_neg, count(*) FILTER (role = 'blank') AS nb,
    avg(value) FILTER (role = 'positive') AS mean_pos, avg(value) FILTER (role = 'negative') AS mean_neg,
    stddev_samp(value) FILTER (role = 'positive') AS sd_pos, stddev_samp(value) FILTER (role = 'negative') AS sd_neg, stddev_samp(value) FILTER (role = 'blank') AS sb,
    median(value) FILTER (role = 'positive') AS ep, median(value) FILTER (role = 'negative') AS en, mad(value) FILTER (role = 'positive') AS ap, mad(value) FILTER (role = 'negative') AS an
  FROM ({IN}) GROUP BY plate)
SELECT plate, n_pos, n_neg, round(mean_pos, 6) AS mean_pos, round(mean_neg, 6) AS mean_neg, round(sd_pos, 6) AS sd_pos, round(sd_neg, 6) AS sd_neg,
  round(CASE WHEN n_pos >= 2 AND n_neg >= 2 AND mean_pos <> mean_neg THEN 1 - 3 * (sd_pos + sd_neg) / abs(mean_pos - mean_neg) END, 6) AS z_prime,
  round(CASE WHEN n_pos >= 2 AND n_neg >= 2 AND ep <> en THEN 1 - 3 * {_K} * (ap + an) / abs(ep - en) END, 6) AS robust_z_prime,
  round(CASE WHEN n_pos >= 2 AND n_neg >= 2 AND sd_pos * sd_pos + sd_neg * sd_neg > 0 THEN (mean_pos - mean_neg) / sqrt(sd_pos * sd_pos + sd_neg * sd_neg) END, 6) AS ssmd,
  round(CASE WHEN mean_neg <> 0 THEN mean_pos / mean_neg END, 6) AS signal_to_background,
  round(CASE WHEN n_pos >= 2 AND n_neg >= 2 AND sd_neg > 0 THEN (mean_pos - mean_neg) / sd_neg END, 6) AS signal_to_noise,
  round(CASE WHEN nb >= 2 AND n_pos >= 2 THEN sd_pos * sd_pos + sb * sb / nb END, 6) AS blank_variance,
  CASE WHEN n_pos < 2 THEN 'fewer than two positive controls' WHEN n_neg < 2 THEN 'fewer than two negative controls' WHEN mean_pos = mean_neg THEN 'controls do not separate' END AS refusal
FROM s""",
    "role_stats": f"""WITH {WELLS}
SELECT plate, role, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(stddev_samp(value) / sqrt(count(*)), 6) AS sem,
  round(CASE WHEN count(*) >= 2 AND min(value) > 0 THEN 100 * stddev_samp(value) / avg(value) END, 6) AS cv,
  round(median(value), 6) AS median, round(mad(value), 6) AS mad, round(mad(value) * {_K}, 6) AS robust_sd
FROM ({IN}) GROUP BY plate, role""",
    "norm_poc": _norm_sql("CASE WHEN mn <> 0 THEN 100 * value / mn END"),
    "norm_npi": _norm_sql("CASE WHEN mn <> mp THEN 100 * (mn - value) / (mn - mp) END"),
    "norm_z": _norm_sql("CASE WHEN sd > 0 THEN (value - m) / sd END"),
    "norm_robust_z": _norm_sql(f"CASE WHEN mad > 0 THEN (value - med) / (mad * {_K}) END"),
    "grubbs": f"""WITH {_values(assay.GRUBBS)}, s AS (
  SELECT l_orderkey, count(*) AS n, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS sd, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1)
SELECT l_orderkey, s.n, round(CASE WHEN sd > 0 AND critical IS NOT NULL THEN greatest(hi - m, m - lo) / sd END, 6) AS statistic, critical,
  CASE WHEN hi - m >= m - lo THEN hi ELSE lo END AS suspect,
  coalesce(CASE WHEN sd > 0 THEN greatest(hi - m, m - lo) / sd END > critical, false) AS flagged
FROM s LEFT JOIN crit ON s.n = crit.n""",
    "dixon": f"""WITH {_values(assay.DIXON)}, s AS (
  SELECT l_orderkey, count(*) AS n, list(l_extendedprice ORDER BY l_extendedprice) AS v FROM lineitem GROUP BY 1),
q AS (SELECT l_orderkey, s.n, critical, CASE WHEN critical IS NOT NULL AND v[-1] > v[1] THEN (v[2] - v[1]) / (v[-1] - v[1]) END AS lo,
  CASE WHEN critical IS NOT NULL AND v[-1] > v[1] THEN (v[-1] - v[-2]) / (v[-1] - v[1]) END AS hi FROM s LEFT JOIN crit ON s.n = crit.n)
SELECT l_orderkey, n, round(lo, 6) AS q_low, round(hi, 6) AS q_high, critical, coalesce(greatest(lo, hi) > critical, false) AS flagged FROM q""",
    "tukey_fences": f"""WITH {WELLS}, q AS (
  SELECT plate, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM ({IN}) GROUP BY plate),
f AS (SELECT *, CASE WHEN n >= 4 AND q3 > q1 THEN q1 - 1.5::DOUBLE * (q3 - q1) END AS lf, CASE WHEN n >= 4 AND q3 > q1 THEN q3 + 1.5::DOUBLE * (q3 - q1) END AS hf FROM q)
SELECT f.plate, n, round(q1, 6) AS q1, round(q3, 6) AS q3, round(lf, 6) AS low_fence, round(hf, 6) AS high_fence,
  count(*) FILTER (value < lf OR value > hf) AS n_outside
FROM f JOIN ({IN}) w ON f.plate = w.plate GROUP BY ALL""",
    "mann_whitney_z": f"""WITH {WELLS}, r AS (
  SELECT plate, row IN (0, 7) OR col IN (0, 11) AS first, count(*) OVER (PARTITION BY plate, value) AS t, rank() OVER (PARTITION BY plate ORDER BY value) AS k FROM ({IN})),
s AS (SELECT plate, count(*) FILTER (first) AS n1, count(*) FILTER (NOT first) AS n2, sum(k + (t - 1) / 2.0::DOUBLE) FILTER (first) AS r1, sum(CAST(t * t - 1 AS DOUBLE)) AS ts, CAST(count(*) AS DOUBLE) AS n FROM r GROUP BY plate),
u AS (SELECT *, n1 * n2 + n1 * (n1 + 1) / 2.0::DOUBLE - r1 AS u, n1 * n2 / 12.0::DOUBLE * ((n + 1) - ts / (n * (n - 1))) AS v FROM s)
SELECT plate, n1, n2, round(u, 6) AS u, round(CASE WHEN v > 0 THEN greatest(0.0::DOUBLE, (abs(u - n1 * n2 / 2.0::DOUBLE) - 0.5::DOUBLE) / sqrt(v)) END, 6) AS z FROM u""",
    "kruskal_h": f"""WITH {WELLS}, big AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY plate, col) AS size FROM ({IN})) WHERE size >= 2),
r AS (SELECT plate, col, count(*) OVER (PARTITION BY plate, value) AS t, rank() OVER (PARTITION BY plate ORDER BY value) AS k FROM big),
l AS (SELECT plate, col, sum(k + (t - 1) / 2.0::DOUBLE) AS r, count(*) AS n, sum(CAST(t * t - 1 AS DOUBLE)) AS ts FROM r GROUP BY ALL),
s AS (SELECT plate, count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(r * r / n) AS s, sum(ts) AS ts FROM l GROUP BY plate),
d AS (SELECT *, CAST(n AS DOUBLE) AS m FROM s)
SELECT plate, k, n, round(CASE WHEN k >= 2 AND 1 - ts / (m * m * m - m) > 0 THEN (12 / (m * (m + 1)) * s - 3 * (m + 1)) / (1 - ts / (m * m * m - m)) END, 6) AS h FROM d""",
}
