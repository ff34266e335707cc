"""Lookups, pack sets, replicates, exposure summaries, stability scores, identities and molecule cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from labspark.operators import alignment_columns, assay, catalog_ops, design, graph, nca
from labspark.plans.pharma import _SEG, KEY
from labspark.plans.views import CONC, WELLS, concentrations, rounded, wells
from labspark.tables import table


def _entries(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("seq"))


def _by_id(s, d):
    """Line items as entries: an id occurs many times, and the first in order counts."""
    items = table(s, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return catalog_ops.by_id(items, table(s, d, "part").select((F.col("p_partkey") * 2).alias("id")))


def _compounds(s, d):
    part, nation = table(s, d, "part"), table(s, d, "nation")
    wanted = part.select(F.upper("p_name").alias("text")).unionByName(part.select((F.col("p_partkey") * 2).cast("string").alias("text")))
    wanted = wanted.unionByName(nation.select(F.col("n_name").alias("text"))).unionByName(nation.filter("n_nationkey < 2").select(F.when(F.col("n_nationkey") == 0, "").alias("text")))
    return catalog_ops.resolve_compounds(_entries(s, d), wanted)


def _targets(s, d):
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("target"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("box"), (F.col("s_nationkey") < 5).alias("headline"))


def _concatenated(s, d):
    builtin = table(s, d, "supplier").select(F.col("s_suppkey").alias("pack_id"), F.col("s_name").alias("title"))
    user = table(s, d, "customer").select(F.col("c_custkey").alias("pack_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("note"))
    return catalog_ops.concatenate(builtin, user)


def _labels(s, d):
    code = F.when(F.col("l_returnflag") == "R", F.col("l_linenumber").cast("string")).when(F.col("l_returnflag") == "A", "")
    return table(s, d, "lineitem").select(*KEY, catalog_ops.position_label(F.col("l_partkey"), code).alias("label"))


def _stability(s, d):
    line = F.col("l_linenumber")
    groups = {"ester": line % 2 == 0, "amide": line % 3 == 0, "catechol": line == 5, "phenol": F.when(line != 7, line > 3), "aryl_ketone": F.col("l_returnflag") == "R"}
    return table(s, d, "lineitem").select(*KEY, *(c.alias(n) for n, c in design.stability(groups, F.col("l_tax") * 50).items()))


def _homologs(s, d):
    """The parts of a brand as homologs of its first part: their names as rows, spaces as gaps."""
    rows = table(s, d, "part").select(F.col("p_brand").alias("brand"), "p_partkey", F.regexp_replace("p_name", " ", "-").alias("row"))
    first = rows.groupBy("brand").agg(F.min_by("row", "p_partkey").alias("query"), F.min("p_partkey").alias("first"))
    pairs = rows.join(first, "brand").filter("p_partkey <> first").select("brand", "query", F.col("row").alias("homolog"))
    return rounded(alignment_columns.homolog_identity(pairs, "brand"), "median", "least", "greatest")


def _cycles(s, d):
    """Suppliers as molecules: part and order numbers of their line items, folded, as atoms, and each item as a bond."""
    items = table(s, d, "lineitem").select(F.col("l_suppkey").alias("supplier"), (F.col("l_partkey") % 97).alias("a"), (F.col("l_orderkey") % 97).alias("b"))
    atoms = items.select("supplier", F.col("a").alias("atom")).unionByName(items.select("supplier", F.col("b").alias("atom")))
    return graph.cycle_rank(atoms, items, "supplier")


QUERIES = {
    "first_by_id": _by_id,
    "resolve_compound": _compounds,
    "dockable_targets": lambda s, d: catalog_ops.dockable(_targets(s, d)),
    "headline_targets": lambda s, d: catalog_ops.dockable(_targets(s, d), headline=True).select("target"),
    "pack_concatenation": _concatenated,
    "position_labels": _labels,
    "replicate_sd": lambda s, d: rounded(assay.replicate_sd(wells(s, d).withColumn("conc", F.round("conc", 9))), "sd"),
    "exposure_summary": lambda s, d: rounded(nca.exposure_summary(concentrations(s, d)), "median_auc", "median_cmax", "auc_cv", places=4),
    "dosing_interval": lambda s, d: rounded(nca.dosing_interval(concentrations(s, d), 240.0), "auc_tau", "c_average", "swing", places=4),
    "stability_scores": _stability,
    "precipitation_rate": lambda s, d: rounded(design.precipitation_rate(concentrations(s, d), "subject", 10.0), "rate", "error"),
    "homolog_identity": _homologs,
    "cycle_rank": _cycles,
}

_BOXED = "FROM supplier WHERE s_acctbal > 0"
ORACLES = {
    "first_by_id": """WITH f AS (SELECT l_partkey AS id, arg_min(l_returnflag, (l_orderkey * 10 + l_linenumber, l_returnflag)) AS name, min(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY 1)
SELECT p_partkey * 2 AS id, f.name, f.seq FROM part LEFT JOIN f ON f.id = p_partkey * 2""",
    "resolve_compound": """WITH w AS (SELECT upper(p_name) AS text FROM part UNION ALL SELECT CAST(p_partkey * 2 AS VARCHAR) FROM part UNION ALL SELECT n_name FROM nation UNION ALL VALUES (''), (NULL)),
k AS (SELECT lower(p_name) AS key, p_partkey AS id FROM part UNION SELECT CAST(p_partkey AS VARCHAR), p_partkey FROM part),
b AS (SELECT key, min(id) AS id FROM k GROUP BY key)
SELECT text, CASE WHEN coalesce(text, '') = '' THEN 'active' WHEN b.id IS NOT NULL THEN 'library' ELSE 'structure' END AS kind, b.id, p_name AS name
FROM w LEFT JOIN b ON lower(text) = b.key AND text <> '' LEFT JOIN part ON p_partkey = b.id""",
    "dockable_targets": f"SELECT s_suppkey AS target, s_acctbal AS box, s_nationkey < 5 AS headline {_BOXED}",
    "headline_targets": f"SELECT s_suppkey AS target {_BOXED} AND s_nationkey < 5",
    "pack_concatenation": "SELECT s_suppkey AS pack_id, s_name AS title, 0 AS origin, CAST(NULL AS VARCHAR) AS note FROM supplier UNION ALL SELECT c_custkey, c_name, 1, c_mktsegment FROM customer",
    "position_labels": f"SELECT {', '.join(KEY)}, l_partkey || CASE WHEN l_returnflag = 'R' THEN '.' || l_linenumber ELSE '' END AS label FROM lineitem",
    "replicate_sd": f"WITH {WELLS} SELECT plate, round(conc, 9) AS conc, count(*) AS n, round(stddev_samp(value), 6) + 0.0::DOUBLE AS sd FROM wells WHERE NOT excluded AND value IS NOT NULL GROUP BY 1, 2",
    "exposure_summary": f"""{_SEG} SELECT count(*) AS n, round(median(auc_last), 4) AS median_auc, round(median(cmax), 4) AS median_cmax,
  CASE WHEN count(*) > 1 AND avg(auc_last) > 0 THEN round(100 * stddev_samp(auc_last) / avg(auc_last), 4) END AS auc_cv FROM ex JOIN peak USING (subject)""",
    "dosing_interval": f"""{_SEG}, i AS (SELECT subject, sum(auc) FILTER (t <= 240) AS area, min(c) FILTER (t <= 240) AS trough, max(c) AS cmax FROM part GROUP BY subject)
SELECT subject, round(CASE WHEN area > 0 THEN area END, 4) AS auc_tau, round(CASE WHEN area > 0 THEN area / 240 END, 4) AS c_average, round(CASE WHEN area > 0 AND trough > 0 THEN (cmax - trough) / trough END, 4) + 0.0::DOUBLE AS swing FROM i""",
    "stability_scores": f"""WITH g AS (SELECT *, l_linenumber % 2 = 0 AS ester, l_linenumber % 3 = 0 AS amide, l_linenumber = 5 AS catechol, l_linenumber IN (4, 5, 6) AS phenol, l_returnflag = 'R' AS ketone FROM lineitem),
f AS (SELECT *, CAST(CASE WHEN ester THEN 34 WHEN amide THEN 70 ELSE 92 END AS DOUBLE) AS hydrolysis, CAST(CASE WHEN catechol THEN 22 WHEN phenol THEN 58 WHEN l_tax * 50 > 2 THEN 76 ELSE 85 END AS DOUBLE) AS oxidation,
  CAST(CASE WHEN catechol OR ketone THEN 54 ELSE 82 END AS DOUBLE) AS photolysis, CAST(CASE WHEN ketone THEN 66 WHEN ester THEN 72 ELSE 88 END AS DOUBLE) AS thermal, CAST(CASE WHEN ester OR ketone OR catechol THEN 58 ELSE 80 END AS DOUBLE) AS ph FROM g)
SELECT {', '.join(KEY)}, hydrolysis, oxidation, photolysis, thermal, ph, (hydrolysis + oxidation + photolysis + thermal + ph) / 5 AS overall FROM f""",
    "precipitation_rate": f"""WITH {CONC}, e AS (SELECT subject, t, CASE WHEN c > 10 THEN ln(c - 10) END AS y FROM conc),
f AS (SELECT subject, count(y) AS n, regr_slope(y, t) AS slope, regr_sxx(y, t) AS sxx, regr_syy(y, t) AS syy, regr_sxy(y, t) AS sxy FROM e GROUP BY subject),
m AS (SELECT *, CASE WHEN n < 2 THEN 'two supersaturated observations' WHEN NOT sxx > 0 THEN 'two distinct times' WHEN slope >= 0 THEN 'a decay' END AS missing FROM f)
SELECT subject, n, round(CASE WHEN missing IS NULL THEN -slope END, 6) + 0.0::DOUBLE AS rate, round(CASE WHEN missing IS NULL THEN CASE WHEN n > 2 THEN sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2) / sxx) ELSE 0.0 END END, 6) + 0.0::DOUBLE AS error, missing FROM m""",
    "homolog_identity": """WITH r AS (SELECT p_brand AS brand, p_partkey, replace(p_name, ' ', '-') AS h FROM part),
q AS (SELECT brand, arg_min(h, p_partkey) AS q, min(p_partkey) AS first FROM r GROUP BY brand),
p AS (SELECT brand, q, h, list_filter(range(1, least(length(q), length(h)) + 1), lambda i: q[i] <> '-' AND h[i] <> '-') AS shared FROM r JOIN q USING (brand) WHERE p_partkey <> first),
x AS (SELECT brand, CASE WHEN len(shared) = 0 THEN 0.0 ELSE 100.0::DOUBLE * len(list_filter(shared, lambda i: q[i] = h[i])) / len(shared) END AS identity FROM p)
SELECT brand, count(*) AS n, round(median(identity), 6) AS median, round(min(identity), 6) AS least, round(max(identity), 6) AS greatest FROM x GROUP BY brand""",
    "cycle_rank": """WITH RECURSIVE i AS (SELECT l_suppkey AS supplier, l_partkey % 97 AS a, l_orderkey % 97 AS b FROM lineitem),
v AS (SELECT supplier, a AS atom FROM i UNION SELECT supplier, b FROM i),
e AS (SELECT DISTINCT supplier, least(a, b) AS a, greatest(a, b) AS b FROM i WHERE a <> b),
g AS (SELECT supplier, a, b FROM e UNION SELECT supplier, b, a FROM e),
r(supplier, atom, low) AS (SELECT supplier, atom, atom FROM v UNION SELECT r.supplier, g.b, r.low FROM r JOIN g ON r.supplier = g.supplier AND r.atom = g.a AND r.low < g.b),
c AS (SELECT supplier, atom, min(low) AS low FROM r GROUP BY ALL),
p AS (SELECT supplier, count(*) AS atoms, count(DISTINCT low) AS parts FROM c GROUP BY supplier),
m AS (SELECT supplier, count(*) AS bonds FROM e GROUP BY supplier)
SELECT supplier, atoms, coalesce(bonds, 0) AS bonds, parts, coalesce(bonds, 0) - atoms + parts AS rings FROM p LEFT JOIN m USING (supplier)""",
}
