"""Protein, oligo and signal queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from labspark.functions import sequence as seq
from labspark.operators import assay, biologics, design, protein, similarity
from labspark.plans.biology import ORACLES as _BIOLOGY
from labspark.plans.biology import _fingerprints
from labspark.plans.views import CONC, POINTS, concentrations, points, rounded, sequences, wells
from labspark.tables import table


def _proteins(s, d):
    return sequences(s, d).select("doc_id", F.replace(seq.translated(F.col("seq")), F.lit("*"), F.lit("")).alias("p"))


def _digest(s, d):
    got = protein.digest(_proteins(s, d), "doc_id", "p", "trypsin", missed=1)
    return rounded(got.groupBy("doc_id", "missed").agg(F.count("*").alias("peptides"), F.sum(F.length("peptide")).alias("residues"), F.max("mass").alias("heaviest")), "heaviest", places=4)


def _oligos(s, d):
    """The names of parts as oligos."""
    letters = F.translate(F.regexp_replace("p_name", "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    rows = table(s, d, "part").select("p_partkey", letters.alias("oligo"))
    return rounded(rows.select("p_partkey", "oligo", *(c.alias(k) for k, c in protein.oligo_thermo(F.col("oligo")).items())), "dh", "ds", "tm", places=5).withColumn("dg37", F.round("dg37", 8))


def _residues(s, d):
    """Ordered and shipped items as the residues of two structures."""
    o = table(s, d, "orders").select((F.col("o_custkey") % 20).alias("chain"), (F.col("o_orderkey") % 997).alias("auth_seq"), F.col("o_orderstatus").alias("icode"))
    i = table(s, d, "lineitem").select((F.col("l_partkey") % 20).alias("chain"), (F.col("l_orderkey") % 997).alias("auth_seq"), F.col("l_linestatus").alias("icode"))
    return protein.pair_residues(o, i).groupBy("chain").agg(F.sum((F.col("in_a") & F.col("in_b")).cast("int")).alias("paired"), F.sum((F.col("in_a") & ~F.col("in_b")).cast("int")).alias("only_a"), F.sum((F.col("in_b") & ~F.col("in_a")).cast("int")).alias("only_b"))


def _surface(s, d):
    p = points(s, d).select("atom", *((F.col(k) * 20).alias(k) for k in "xyz"), F.lit(1.7).alias("radius"))
    return rounded(protein.surface(p), "area", places=4)


def _derivative(s, d):
    daily = concentrations(s, d).groupBy(F.lit(1).alias("curve"), F.floor(F.col("t") / 6).alias("bin")).agg(F.avg("c").alias("c"))
    return rounded(design.savitzky_golay(daily, "curve", "bin", "c").drop("c"), "dy")


def _balance(s, d):
    """Orders as reactions: items are terms, the sign of the flag tells the side."""
    side = F.when(F.col("l_returnflag") == "N", 1.0).otherwise(-1.0)
    comp = F.create_map(F.lit("C"), (F.col("l_partkey") % 4).cast("double"), F.lit("H"), (F.col("l_suppkey") % 3).cast("double"))
    terms = table(s, d, "lineitem").select(F.col("l_orderkey").alias("reaction"), (side * F.col("l_linenumber")).alias("coefficient"), F.when(F.col("l_quantity") > 1, comp).alias("composition"))
    return design.element_balance(terms).withColumn("unbalanced", F.array_join("unbalanced", ","))


def _p_values(s, d):
    ring = F.col("row").isin(0, 7) | F.col("col").isin(0, 11)
    w = assay.included(wells(s, d))
    mw, kw = assay.mann_whitney(w, "plate", ring), assay.kruskal_wallis(w, "plate", "col")
    got = mw.join(kw, "plate").select("plate", design.p_two_sided(F.col("z")).alias("edge_p"), design.p_chi2(F.col("h"), F.col("k") - 1).alias("column_p"))
    return rounded(got, "edge_p", "column_p")


def _bonds(s, d):
    atoms = points(s, d).select("atom", *((F.col(k) * 8).alias(k) for k in "xyz"), F.lit(0.5).alias("covalent"))
    return rounded(biologics.inferred_bonds(atoms), "distance")


def _peptides(s, d):
    names = table(s, d, "nation").select("n_nationkey", F.regexp_replace(F.upper("n_name"), "[^ACDEFGHIKLMNPQRSTVWY]", "").alias("p"))
    return names.withColumn("p", F.when(F.col("n_nationkey") % 2 == 0, F.concat("p", F.lit("K"))).otherwise(F.col("p")))


def _scorecard(s, d):
    """Customers like the first customer of each nation, scheduled by their ids."""
    prints = _fingerprints(s, d)
    first = table(s, d, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("id")).select("id")
    hits = similarity.tanimoto_top_k(prints.join(first, "id", "left_semi"), prints).withColumn("schedule", F.concat(F.lit("Schedule "), F.repeat(F.lit("I"), (F.col("id") % 3 + 1).cast("int"))))
    return rounded(biologics.scorecard(hits), "similarity")


QUERIES = {
    "inferred_bonds": _bonds,
    "mass_ladder": lambda s, d: rounded(biologics.mass_ladder(_peptides(s, d), "n_nationkey", "p"), "mass", places=4),
    "scorecard": _scorecard,
    "developability": lambda s, d: rounded(biologics.developability(_peptides(s, d).filter("length(p) > 0"), "n_nationkey", "p"), "gravy", "aliphatic", "charge", "pi"),
    "digest_peptides": _digest,
    "oligo_thermo": _oligos,
    "residue_pairs": _residues,
    "surface": _surface,
    "chain_gaps": lambda s, d: rounded(protein.chain_gaps(points(s, d).withColumnRenamed("atom", "order"), 0.3), "distance"),
    "ligand_box": lambda s, d: rounded(protein.box_of(points(s, d)), *(f"{a}{k}" for a in "cs" for k in "xyz")),
    "melt_derivative": _derivative,
    "reaction_balance": _balance,
    "rank_p_values": _p_values,
    "shelf_life": lambda s, d: rounded(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", design.shelf_life(F.col("l_tax"), F.lit(100.0), F.col("l_quantity")).alias("life")), "life"),
    "design_coverage": lambda s, d: rounded(design.simulate_fits(s, [10.0 ** (-9 + 0.5 * i) for i in range(10)], [100.0, 1.0, -7.0, 0.0], 2.0, 100, 20260813), "log_ec50", "error"),
}

_NN = lambda k: " + ".join(f"{v[k]}::DOUBLE * len(list_filter(pairs, lambda x: x = '{p}'))" for p, v in protein.NEAREST.items())
_END = lambda k: " + ".join(f"CASE WHEN {e} IN ('G', 'C') THEN {protein.END_GC[k]}::DOUBLE ELSE {protein.END_AT[k]}::DOUBLE END" for e in ("o[1]", "o[-1]"))
_AT = "20::DOUBLE * "
_SPHERE = ", ".join(f"({i}, {x!r}::DOUBLE, {y!r}::DOUBLE, {z!r}::DOUBLE)" for i, (x, y, z) in enumerate(protein.sphere()))
ORACLES: dict[str, str] = {
    "inferred_bonds": f"""WITH {POINTS}, a AS (SELECT atom, 8 * x AS x, 8 * y AS y, 8 * z AS z FROM points), p AS (SELECT a.atom AS atom_1, b.atom AS atom_2, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS distance FROM a JOIN a b ON a.atom < b.atom)
SELECT atom_1, atom_2, round(distance, 6) AS distance FROM p WHERE distance <= 1.45::DOUBLE AND distance > 0.4::DOUBLE""",
    "mass_ladder": f"""WITH p AS (SELECT n_nationkey, regexp_replace(upper(n_name), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') || CASE WHEN n_nationkey % 2 = 0 THEN 'K' ELSE '' END AS p FROM nation),
b AS (SELECT *, {protein.WATER}::DOUBLE + {' + '.join(f"{m}::DOUBLE * (length(p) - length(replace(p, '{a}', '')))" for a, m in protein.RESIDUE_MASS.items())} AS base FROM p),
f(glycan, extra) AS (VALUES {', '.join(f"('{g}', {m}::DOUBLE)" for g, m in biologics.GLYCANS.items())}), c(clipped) AS (VALUES (0), (1))
SELECT n_nationkey, glycan, clipped, round(base + extra - clipped * {protein.RESIDUE_MASS['K']}::DOUBLE, 4) AS mass FROM b, f, c WHERE clipped = 0 OR p LIKE '%K'""",
    "oligo_thermo": f"""WITH o AS (SELECT p_partkey, translate(regexp_replace(p_name, '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS o FROM part),
p AS (SELECT *, list_transform(range(1, length(o)), lambda i: substr(o, i, 2)) AS pairs, o = reverse(translate(o, 'ACGT', 'TGCA')) AS same FROM o),
t AS (SELECT *, {_NN(0)} + {_END(0)} AS h, {_NN(1)} + {_END(1)} + CASE WHEN same THEN {protein.SYMMETRY}::DOUBLE ELSE 0 END AS s FROM p)
SELECT p_partkey, o AS oligo, round(h, 5) AS dh, round(s, 5) AS ds, round(h - 310.15::DOUBLE * s / 1000, 8) AS dg37,
  round(1000 * h / (s + 0.368::DOUBLE * (length(o) - 1) * {math.log(0.05)!r}::DOUBLE + {protein.GAS_CAL}::DOUBLE * CASE WHEN same THEN {math.log(2.5e-7)!r}::DOUBLE ELSE {math.log(2.5e-7 / 4)!r}::DOUBLE END) - 273.15::DOUBLE, 5) AS tm FROM t""",
    "residue_pairs": """WITH a AS (SELECT DISTINCT o_custkey % 20 AS chain, o_orderkey % 997 AS n, o_orderstatus AS i, true AS x FROM orders), b AS (SELECT DISTINCT l_partkey % 20 AS chain, l_orderkey % 997 AS n, l_linestatus AS i, true AS y FROM lineitem)
SELECT chain, count(*) FILTER (x AND y) AS paired, count(*) FILTER (x AND y IS NULL) AS only_a, count(*) FILTER (y AND x IS NULL) AS only_b FROM a FULL JOIN b USING (chain, n, i) GROUP BY chain""",
    "surface": f"""WITH {POINTS}, a AS (SELECT atom, {_AT}x AS x, {_AT}y AS y, {_AT}z AS z FROM points), dots(i, dx, dy, dz) AS (VALUES {_SPHERE}),
c AS (SELECT DISTINCT p.atom, i FROM a p JOIN a q ON p.atom <> q.atom AND sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)) < 6.2::DOUBLE, dots
  WHERE (p.x - q.x + 3.1::DOUBLE * dx) * (p.x - q.x + 3.1::DOUBLE * dx) + (p.y - q.y + 3.1::DOUBLE * dy) * (p.y - q.y + 3.1::DOUBLE * dy) + (p.z - q.z + 3.1::DOUBLE * dz) * (p.z - q.z + 3.1::DOUBLE * dz) < 3.1::DOUBLE * 3.1::DOUBLE),
k AS (SELECT atom, count(*) AS n FROM c GROUP BY atom)
SELECT a.atom, round(4 * pi() * 3.1::DOUBLE * 3.1::DOUBLE * (92 - coalesce(n, 0)) / 92, 4) AS area FROM a LEFT JOIN k USING (atom)""",
    "chain_gaps": f"""WITH {POINTS}, g AS (SELECT chain, atom AS "order", lead(atom) OVER w AS next, sqrt(pow(x - lead(x) OVER w, 2) + pow(y - lead(y) OVER w, 2) + pow(z - lead(z) OVER w, 2)) AS distance FROM points WINDOW w AS (PARTITION BY chain ORDER BY atom))
SELECT chain, "order", next, round(distance, 6) AS distance FROM g WHERE distance > 0.3::DOUBLE""",
    "ligand_box": f"WITH {POINTS} SELECT " + ", ".join([f"round((min({k}) + max({k})) / 2, 6) + 0.0::DOUBLE AS c{k}" for k in "xyz"] + [f"round(max({k}) - min({k}) + 8, 6) AS s{k}" for k in "xyz"]) + " FROM points",
    "melt_derivative": f"""WITH {CONC}, b AS (SELECT CAST(floor(t / 6) AS BIGINT) AS bin, avg(c) AS c FROM conc GROUP BY 1), s AS (SELECT *, bin - lag(bin) OVER w AS step,
  {' + '.join(f'{k / 60!r}::DOUBLE * (lead(c, {k}) OVER w - lag(c, {k}) OVER w)' for k in (1, 2, 3, 4))} AS slope FROM b WINDOW w AS (ORDER BY bin))
SELECT 1 AS curve, bin, round(CASE WHEN coalesce(stddev_samp(step) OVER (), 0) <= 0.05 * avg(step) OVER () THEN slope / avg(step) OVER () END, 6) + 0.0::DOUBLE AS dy FROM s""",
    "reaction_balance": """WITH t AS (SELECT l_orderkey AS reaction, CASE WHEN l_returnflag = 'N' THEN 1 ELSE -1 END * l_linenumber AS q, l_quantity > 1 AS known, l_partkey % 4 AS c, l_suppkey % 3 AS h FROM lineitem),
s AS (SELECT reaction, coalesce(sum(q * c) FILTER (known), 0) AS c, coalesce(sum(q * h) FILTER (known), 0) AS h, count(*) FILTER (NOT known) AS missing FROM t GROUP BY 1)
SELECT reaction, CASE WHEN c <> 0 AND h <> 0 THEN 'C,H' WHEN c <> 0 THEN 'C' WHEN h <> 0 THEN 'H' ELSE '' END AS unbalanced, missing, missing = 0 AND c = 0 AND h = 0 AS balanced FROM s""",
    "shelf_life": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_tax > 0 AND l_quantity > 0 AND l_quantity <= 100 THEN ln(100 / l_quantity) / l_tax END, 6) + 0.0::DOUBLE AS life FROM lineitem",
}
ORACLES["scorecard"] = f"""WITH h AS ({_BIOLOGY["tanimoto_topk"].replace("round(tanimoto, 9) AS tanimoto", "tanimoto")})
SELECT query_id, round(100 * max(tanimoto), 6) AS similarity, coalesce(bool_or(tanimoto >= 0.75 AND id % 3 IN (0, 1)), false) AS controlled,
  CASE WHEN max(tanimoto) >= 0.75 THEN 'close' WHEN max(tanimoto) >= 0.5 THEN 'related' ELSE 'distant' END AS band FROM h GROUP BY query_id"""
