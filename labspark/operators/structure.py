"""Structure geometry over atom tables: contacts, clashes, lDDT and superposition moments.

Distance joins are equal joins on cells of a grid as wide as the cutoff: an atom meets the
27 cells around its own, so work follows the number of neighbours, not the square of atoms.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def grid_join(left: DataFrame, right: DataFrame, cutoff: float, keep: str = "true") -> DataFrame:
    """Pairs of left and right rows within cutoff, with columns suffixed _1 and _2 and d2 (squared distance).

    keep is a further condition on the suffixed columns, applied before the distance.
    """
    cell = lambda c: F.floor(F.col(c) / cutoff)
    a = left.select(*(F.col(c).alias(f"{c}_1") for c in left.columns), *(cell(c).alias(f"g{c}") for c in XYZ))
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)))
    b = right.select(*(F.col(c).alias(f"{c}_2") for c in right.columns), *(cell(c).alias(f"h{c}") for c in XYZ), F.explode(around).alias("o"))
    b = b.select(*(f"{c}_2" for c in right.columns), *((F.col(f"h{c}") + F.col(f"o.{o}")).alias(f"g{c}") for c, o in zip(XYZ, "ijk", strict=True)))
    d2 = sum((F.pow(F.col(f"{c}_1") - F.col(f"{c}_2"), F.lit(2.0)) for c in XYZ[1:]), F.pow(F.col("x_1") - F.col("x_2"), F.lit(2.0)))
    joined = a.join(b, [f"g{c}" for c in XYZ]).filter(F.expr(keep)).drop(*(f"g{c}" for c in XYZ))
    return joined.withColumn("d2", d2).filter(F.col("d2") <= cutoff * cutoff)


def contacts(atoms: DataFrame, cutoff: float) -> DataFrame:
    """Atom pairs of different chains (chain_1 < chain_2) within cutoff."""
    return grid_join(atoms, atoms, cutoff, "chain_1 < chain_2")


def clashes(atoms: DataFrame, radius: float, scale: float = 0.75) -> DataFrame:
    """Atom pairs (atom_1 < atom_2) closer than scale times the sum of their radii."""
    return grid_join(atoms, atoms, 2 * radius * scale, "atom_1 < atom_2").filter(F.col("d2") < (2 * radius * scale) ** 2)


def lddt(reference: DataFrame, model: DataFrame, radius: float, tolerances: tuple[float, ...]) -> DataFrame:
    """Share of preserved distances by atom: pairs within radius in the reference, mean over the tolerances.

    model has the atoms' other coordinates under the same ids; pairs without a partner there
    are left out.
    """
    pairs = grid_join(reference, reference, radius, "atom_1 <> atom_2")
    side = lambda k: model.select(F.col("atom").alias(f"atom_{k}"), *(F.col(c).alias(f"m{c}_{k}") for c in XYZ))
    both = pairs.join(side(1), "atom_1").join(side(2), "atom_2")
    there = F.sqrt(sum((F.pow(F.col(f"m{c}_1") - F.col(f"m{c}_2"), F.lit(2.0)) for c in XYZ[1:]), F.pow(F.col("mx_1") - F.col("mx_2"), F.lit(2.0))))
    change = F.abs(F.sqrt("d2") - there)
    kept = sum(((change < t).cast("double") for t in tolerances[1:]), (change < tolerances[0]).cast("double")) / len(tolerances)
    return both.groupBy(F.col("atom_1").alias("atom")).agg(F.count("*").alias("pairs"), F.avg(kept).alias("lddt"))


def moments(atoms: DataFrame, group: str) -> DataFrame:
    """n, centroid and radius of gyration by group."""
    square = sum((F.col(c) * F.col(c) for c in XYZ[1:]), F.col("x") * F.col("x"))
    got = atoms.groupBy(group).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"c{c}") for c in XYZ), F.avg(square).alias("s"))
    centre = sum((F.col(f"c{c}") * F.col(f"c{c}") for c in XYZ[1:]), F.col("cx") * F.col("cx"))
    return got.withColumn("gyration", F.sqrt(F.greatest(F.lit(0.0), F.col("s") - centre))).drop("s")


def kabsch(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Rotation, translation and RMSD that best lay p on q; a reflection is never used."""
    cp, cq = p.mean(axis=0), q.mean(axis=0)
    u, _, vt = np.linalg.svd((p - cp).T @ (q - cq))
    turn = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0])
    rotation = vt.T @ turn @ u.T
    moved = (p - cp) @ rotation.T + cq
    return rotation, cq - rotation @ cp, float(np.sqrt(((moved - q) ** 2).sum(axis=1).mean()))


def superpose(pairs: DataFrame, group: str) -> DataFrame:
    """n and rmsd after superposition by group; pairs have x, y, z and mx, my, mz. Fewer than three pairs: NULL.

    The rotation needs only covariances, which Spark keeps centred as it merges them, so
    groups of any size reduce to one row natively before the small decomposition. The RMSD
    is then measured on the rotated points themselves, as a difference of sums would lose
    half of the digits.
    """
    cov = [F.covar_pop(F.col(a), F.col(f"m{b}")).alias(f"s{a}{b}") for a in XYZ for b in XYZ]
    rows = pairs.groupBy(group).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"p{c}") for c in XYZ), *(F.avg(f"m{c}").alias(f"q{c}") for c in XYZ), *cov)

    @F.pandas_udf("array<double>")
    def rotation(parts: pd.DataFrame) -> pd.Series:
        out = []
        for r in parts.itertuples(index=False):
            u, _, vt = np.linalg.svd(np.array([[getattr(r, f"s{a}{b}") for b in XYZ] for a in XYZ]))
            turn = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0])
            out.append((vt.T @ turn @ u.T).ravel().tolist())
        return pd.Series(out)

    names = [c for c in rows.columns if c.startswith("s") and c != group]
    fits = rows.withColumn("turn", rotation(F.struct(*names))).select(F.col(group).alias("fit"), "n", "turn", *(f"{s}{c}" for s in "pq" for c in XYZ))
    both = pairs.join(fits, pairs[group].eqNullSafe(F.col("fit")))
    left = [F.col(c) - F.col(f"p{c}") for c in XYZ]
    off = [sum((F.col("turn")[3 * i + j] * left[j] for j in range(1, 3)), F.col("turn")[3 * i] * left[0]) - (F.col(f"m{c}") - F.col(f"q{c}")) for i, c in enumerate(XYZ)]
    square = off[0] * off[0] + off[1] * off[1] + off[2] * off[2]
    got = both.groupBy(group).agg(F.max("n").alias("n"), F.sqrt(F.avg(square)).alias("rmsd"))
    return got.select(group, "n", F.when(F.col("n") >= 3, F.col("rmsd")).alias("rmsd"))
