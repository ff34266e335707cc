"""Protein and oligo operators: pairing, torsions, gaps, surface, digests, masses, thermodynamics, variants."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labspark.operators.structure import grid_join

RESIDUE = ("chain", "auth_seq", "icode")
# Monoisotopic residue masses, water and the proton.
RESIDUE_MASS = {"G": 57.02146, "A": 71.03711, "S": 87.03203, "P": 97.05276, "V": 99.06841, "T": 101.04768, "C": 103.00919, "L": 113.08406, "I": 113.08406, "N": 114.04293, "D": 115.02694, "Q": 128.05858, "K": 128.09496, "E": 129.04259, "M": 131.04049, "H": 137.05891, "F": 147.06841, "R": 156.10111, "Y": 163.06333, "W": 186.07931}
WATER, PROTON = 18.01056, 1.00728
# Unified nearest-neighbour enthalpy (kcal/mol) and entropy (cal/mol/K) of DNA, ends and symmetry.
NEAREST = {"AA": (-7.9, -22.2), "TT": (-7.9, -22.2), "AT": (-7.2, -20.4), "TA": (-7.2, -21.3), "CA": (-8.5, -22.7), "TG": (-8.5, -22.7), "GT": (-8.4, -22.4), "AC": (-8.4, -22.4), "CT": (-7.8, -21.0), "AG": (-7.8, -21.0), "GA": (-8.2, -22.2), "TC": (-8.2, -22.2), "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.9), "CC": (-8.0, -19.9)}
END_GC, END_AT, SYMMETRY, GAS_CAL = (0.1, -2.8), (2.3, 4.1), -1.4, 1.9872
# Van der Waals radii, with the rest at 1.7.
RADII = {"C": 1.70, "N": 1.55, "O": 1.52, "S": 1.80, "H": 1.10, "P": 1.80}
#: Cleavage after these residues, unless before those.
PROTEASES = {"trypsin": ("KR", "P"), "lys-c": ("K", ""), "arg-c": ("R", "P"), "glu-c": ("E", "P"), "chymotrypsin": ("FWY", "P"), "asp-n": ("", "")}


def pair_residues(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer pairing of two residue tables on chain, number and insertion code; in_a and in_b tell who has it."""
    left, right = (d.select(*RESIDUE, F.lit(True).alias(n)).distinct() for d, n in ((a, "in_a"), (b, "in_b")))
    return left.join(right, list(RESIDUE), "full").select(*RESIDUE, F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def dihedral(p: list[list[Column]]) -> Column:
    """Torsion of four points in degrees; NULL where they are in line."""
    b = [[q[k] - r[k] for k in range(3)] for q, r in zip(p[1:], p[:3], strict=True)]
    n1, n2 = _cross(b[0], b[1]), _cross(b[1], b[2])
    length = F.sqrt(_dot(b[1], b[1]))
    y, x = _dot(_cross(n1, n2), b[1]) / F.nullif(length, F.lit(0.0)), _dot(n1, n2)
    return F.when((y != 0) | (x != 0), F.degrees(F.atan2(y, x)))


def torsions(backbone: DataFrame) -> DataFrame:
    """phi and psi by residue, from one row a residue with structs n, ca and c of x, y, z; NULL at chain ends."""
    by = Window.partitionBy("chain").orderBy("auth_seq", "icode")
    at = lambda c: [c[k] for k in "xyz"]
    rows = backbone.withColumn("c0", F.lag("c").over(by)).withColumn("n1", F.lead("n").over(by))
    n, ca, c = (at(F.col(k)) for k in ("n", "ca", "c"))
    phi, psi = dihedral([at(F.col("c0")), n, ca, c]), dihedral([n, ca, c, at(F.col("n1"))])
    return rows.select(*RESIDUE, F.when(F.col("c0").isNotNull(), phi).alias("phi"), F.when(F.col("n1").isNotNull(), psi).alias("psi"))


def chain_gaps(alpha: DataFrame, limit: float = 4.5) -> DataFrame:
    """Neighbours along a chain whose alpha carbons are further apart than limit: rows of chain, order, x, y, z."""
    by = Window.partitionBy("chain").orderBy("order")
    rows = alpha.select("chain", "order", F.struct("x", "y", "z").alias("p")).withColumn("q", F.lead("p").over(by)).withColumn("next", F.lead("order").over(by))
    d = F.sqrt(sum((F.pow(F.col(f"p.{k}") - F.col(f"q.{k}"), F.lit(2.0)) for k in "yz"), F.pow(F.col("p.x") - F.col("q.x"), F.lit(2.0))))
    return rows.filter("q IS NOT NULL").select("chain", "order", "next", d.alias("distance")).filter(F.col("distance") > limit)


def sphere(n: int = 92) -> list[tuple[float, float, float]]:
    """n points spread evenly over the unit sphere along a spiral."""
    i = np.arange(n) + 0.5
    z, turn = 1 - 2 * i / n, math.pi * (1 + 5**0.5) * i
    r = np.sqrt(1 - z * z)
    return [tuple(map(float, p)) for p in np.column_stack([r * np.cos(turn), r * np.sin(turn), z])]


def surface(atoms: DataFrame, probe: float = 1.4, points: int = 92) -> DataFrame:
    """Accessible area of each atom (atom, x, y, z, radius): the share of its probe sphere's points that no neighbour covers.

    Neighbours come from a grid join, points are spread only over atoms and their neighbours,
    and covered points are counted as distinct numbers, so no pair beyond reach is made.
    """
    own = atoms.select("atom", "x", "y", "z", (F.col("radius") + probe).alias("reach"))
    widest = float(own.agg(F.coalesce(F.max("reach"), F.lit(0.0))).first()[0])
    if widest == 0:
        return own.select("atom", F.lit(0.0).alias("area"))
    near = grid_join(own, own, 2 * widest, "atom_1 <> atom_2").filter(F.sqrt("d2") < F.col("reach_1") + F.col("reach_2"))
    dots = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z")) for i, (x, y, z) in enumerate(sphere(points))))
    offset = {k: F.col(f"{k}_1") - F.col(f"{k}_2") for k in "xyz"}

    def hidden(p: Column) -> Column:
        d2 = sum(((offset[k] + F.col("reach_1") * p[k]) * (offset[k] + F.col("reach_1") * p[k]) for k in "yz"), (offset["x"] + F.col("reach_1") * p["x"]) * (offset["x"] + F.col("reach_1") * p["x"]))
        return d2 < F.col("reach_2") * F.col("reach_2")

    covered = near.select(F.col("atom_1").alias("atom"), F.explode(F.transform(F.filter(dots, hidden), lambda p: p["i"])).alias("i")).distinct().groupBy("atom").agg(F.count("*").alias("covered"))
    area = 4 * math.pi * F.col("reach") * F.col("reach") * (points - F.coalesce("covered", F.lit(0))) / points
    return own.join(covered, "atom", "left").select("atom", area.alias("area"))


def peptide_mass(peptide: Column) -> Column:
    """Monoisotopic mass; NULL with a letter that has no mass."""
    count = lambda a: F.length(peptide) - F.length(F.replace(peptide, F.lit(a), F.lit("")))
    total = sum((F.lit(m) * count(a) for a, m in RESIDUE_MASS.items()), F.lit(WATER))
    return F.when(F.translate(peptide, "".join(RESIDUE_MASS), "") == "", total)


def digest(proteins: DataFrame, key: str, seq: str, protease: str = "trypsin", missed: int = 2, min_length: int = 4) -> DataFrame:
    """Peptides with their 0-based start, missed cleavages and mass; a zero-width split keeps every residue."""
    after, before = PROTEASES[protease]
    site = "(?=D)" if protease == "asp-n" else f"(?<=[{after}])" + (f"(?![{before}])" if before else "") + "(?!$)"
    parts = F.filter(F.split(seq, site), lambda p: F.length(p) > 0)
    rows = proteins.select(key, F.posexplode(parts).alias("part", "peptide"))
    by = Window.partitionBy(key).orderBy("part")
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("peptide")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumns({f"next_{k}": F.lead("peptide", k).over(by) for k in range(1, missed + 1)})
    joined = [F.struct(F.lit(m).alias("missed"), F.concat(F.col("peptide"), *(F.col(f"next_{k}") for k in range(1, m + 1))).alias("peptide")) for m in range(missed + 1)]
    out = rows.select(key, "start", F.explode(F.array(*joined)).alias("p")).select(key, "start", "p.missed", "p.peptide").filter(F.length("peptide") >= min_length)
    return out.withColumn("mass", peptide_mass(F.col("peptide")))


def oligo_thermo(oligo: Column, sodium: float = 0.05, strand: float = 2.5e-7) -> dict[str, Column]:
    """dh, ds, dg37 and tm of a DNA duplex from its nearest neighbours; NULL for other letters or under two bases."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(oligo) - 1, F.lit(1))), lambda i: F.substr(oligo, i, F.lit(2)))
    steps = lambda k: sum((F.lit(v[k]) * (F.size(pairs) - F.size(F.array_remove(pairs, p))) for p, v in NEAREST.items()), F.lit(0.0))
    ends = lambda k: sum((F.when(F.substr(oligo, at, F.lit(1)).isin("G", "C"), END_GC[k]).otherwise(END_AT[k]) for at in (F.lit(1), F.length(oligo))), F.lit(0.0))
    same = oligo == F.reverse(F.translate(oligo, "ACGT", "TGCA"))
    good = (F.length(oligo) >= 2) & (F.translate(oligo, "ACGT", "") == "")
    dh = steps(0) + ends(0)
    ds = steps(1) + ends(1) + F.when(same, SYMMETRY).otherwise(0.0)
    salted = ds + 0.368 * (F.length(oligo) - 1) * math.log(sodium)
    tm = 1000 * dh / (salted + GAS_CAL * F.when(same, math.log(strand)).otherwise(math.log(strand / 4))) - 273.15
    return {k: F.when(good, v) for k, v in {"dh": dh, "ds": ds, "dg37": dh - 310.15 * ds / 1000, "tm": tm}.items()}


def conservation(aligned: DataFrame, query: str, min_homologs: int = 15, pseudocount: float = 0.05) -> DataFrame:
    """column, residue (of the query), depth, entropy, gap_fraction and sift-like scores source: rows are (row, sequence).

    Below min_homologs rows the profile is marked unusable and its figures are NULL.
    """
    letters = aligned.select("row", F.posexplode(F.split("sequence", "")).alias("column", "residue")).filter("residue <> ''")
    counts = letters.groupBy("column", "residue").agg(F.count("*").alias("n"))
    depth = counts.groupBy("column").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("residue") != "-", F.col("n")).otherwise(0)).alias("depth"))
    p = F.col("n") / F.nullif(F.col("depth"), F.lit(0))
    terms = counts.filter("residue <> '-'").join(depth, "column").groupBy("column").agg((-F.sum(p * F.log2(p))).alias("entropy"), F.max((F.col("n") + pseudocount) / (F.col("depth") + 20 * pseudocount)).alias("top"))
    own = letters.filter(F.col("row") == query).select("column", "residue")
    usable = F.col("rows") >= min_homologs
    return depth.join(terms, "column", "left").join(own, "column", "left").select("column", "residue", "depth", F.when(usable, F.col("entropy")).alias("entropy"), (1 - F.col("depth") / F.col("rows")).alias("gap_fraction"), F.when(usable, F.col("top")).alias("top"), usable.alias("usable"))


def sift_score(count: Column, depth: Column, top: Column, pseudocount: float = 0.05) -> Column:
    """Posterior of a residue over that of the column's commonest."""
    return (count + pseudocount) / (depth + 20 * pseudocount) / top


def vina_results(lines: DataFrame) -> DataFrame:
    """pose, affinity and the RMSD bounds from the text lines of a docking output (line_no, value)."""
    rows = lines.filter(F.col("value").startswith("REMARK VINA RESULT:"))
    part = F.split(F.trim(F.substring_index("value", ":", -1)), r"\s+")
    number = lambda i: F.expr(f"try_cast(split(trim(substring_index(value, ':', -1)), '\\\\s+')[{i}] AS double)")
    return rows.filter(F.size(part) >= 3).select(F.row_number().over(Window.orderBy("line_no")).alias("pose"), number(0).alias("affinity"), number(1).alias("rmsd_low"), number(2).alias("rmsd_high"))


def box_of(atoms: DataFrame, margin: float = 4.0) -> DataFrame:
    """Centre and edges of the box around a ligand's atoms; without atoms no row."""
    a = atoms.agg(F.count("*").alias("n"), *(F.min(k).alias(f"l{k}") for k in "xyz"), *(F.max(k).alias(f"h{k}") for k in "xyz")).filter("n > 0")
    return a.select(*(((F.col(f"l{k}") + F.col(f"h{k}")) / 2).alias(f"c{k}") for k in "xyz"), *((F.col(f"h{k}") - F.col(f"l{k}") + 2 * margin).alias(f"s{k}") for k in "xyz"))
