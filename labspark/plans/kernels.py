"""Queries whose figures come from numeric kernels; they have no SQL form and are tested against closed forms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from labspark.functions import sequence as seq
from labspark.kernels.network import Network, Reaction
from labspark.operators import batch
from labspark.plans.views import rounded, sequences, wells
from labspark.tables import table

#: Building blocks that part numbers combine to molecules.
HEADS, TAILS = ("C", "CC", "CC(C)", "OC", "NC", "c1ccccc1", "FC(F)(F)", "O=C(O)C"), ("O", "N", "C(=O)O", "C#N", "C(=O)OC", "c1ccncc1", "S", "Cl")


def molecules(s, d):
    """part as molecules: the key picks a head, a chain length and a tail."""
    pick = lambda xs, i: F.get(F.array(*(F.lit(x) for x in xs)), i.cast("int"))
    k = F.col("p_partkey")
    return table(s, d, "part").select(k.alias("id"), F.concat(pick(HEADS, k % 8), F.repeat(F.lit("C"), (k / 64).cast("int") % 5), pick(TAILS, (k / 8).cast("int") % 8)).alias("smiles"))


def _props(s, d):
    got = batch.smiles_props(molecules(s, d)).select("id", "smiles", "props.*")
    return rounded(got.withColumn("fingerprint", F.size("fingerprint")).withColumn("groups", F.concat_ws(",", "groups")), "mol_weight", "mono_mass", "fsp3", "tpsa")


def _hits(s, d):
    from labspark.kernels.chem import ALERTS, GROUPS

    patterns = {k: GROUPS[k] for k in ("acid", "alcohol", "amine", "aryl", "ester", "halide")} | {k: ALERTS[k][0] for k in ("aniline", "michael_acceptor")}
    got = batch.smarts_hits(molecules(s, d), patterns)
    return got.select("id", *(F.col("hits")[k].alias(k) for k in patterns))


def _proteins(s, d):
    """Peptides of the nations' names and the regions': every nation against its region."""
    clean = lambda c: F.regexp_replace(F.upper(c), "[^ARNDCQEGHILKMFPSTWYV]", "")
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", clean(F.col("n_name")).alias("a"), clean(F.col("r_name")).alias("b"))


def _curves(s, d):
    """Mean readout by plate and concentration step, as a curve that falls with the step."""
    w = wells(s, d).filter("role = 'sample' AND NOT excluded").groupBy("plate", "conc").agg(F.avg("value").alias("m"))
    curve = F.lit(5.0) + 90 / (1 + F.pow(F.lit(10.0), -(F.log10("conc") + 5 + (F.col("plate") % 7) / 10)))
    return batch.fit_curves(w.select("plate", "conc", (curve + F.col("m") * 0.01).alias("value")), "plate", "logistic4")


def _decay():
    return Network({"A": 40.0, "B": 0.0}, [Reaction("decay", {"A": 1}, {"B": 1}, "mass_action", {"k": 0.5})])


def _fva(s, d):
    stoichiometry = np.array([[1, -1, -1, 0], [0, 1, 0, -1], [0, 0, 1, -1.0]])
    return rounded(batch.flux_variability(s, stoichiometry, np.array([0, 0, 0, 1.0]), np.zeros(4), np.array([10, 8, 8, 100.0]), ["uptake", "left", "right", "growth"]), "least", "greatest")


def _profiles(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("subject"), F.lit(100.0).alias("dose"), (20 + F.col("c_nationkey")).cast("double").alias("v"), (1 + F.col("c_custkey") % 7).cast("double").alias("cl"), F.when(F.col("c_custkey") % 2 == 0, 1.1).alias("ka"))
    return rounded(batch.pk_profiles(c, [0.0, 1.0, 4.0, 12.0]), "c")


def _leaders(s, d):
    p = table(s, d, "supplier").select((F.col("s_nationkey")).alias("family"), F.col("s_suppkey").alias("id"), seq.translate(F.translate(F.md5(F.col("s_nationkey").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")).alias("protein"))
    return batch.leader_clusters(p, "family", "protein", "id")


QUERIES = {
    "smiles_props": _props,
    "smarts_hits": _hits,
    "align_pairs": lambda s, d: rounded(batch.align_pairs(_proteins(s, d), "a", "b"), "identity"),
    "fit_4pl": _curves,
    "b_score": lambda s, d: rounded(batch.b_score(wells(s, d).groupBy("plate", "row", "col").agg(F.avg("value").alias("value"))), "value", "b_score"),
    "ssa_ensemble": lambda s, d: batch.ssa_ensemble(s, _decay(), 1.0, 400, 7),
    "fba": _fva,
    "pk_profiles": _profiles,
    "leader_clusters": _leaders,
    "orfs": lambda s, d: batch.orfs(sequences(s, d), "doc_id", "seq"),
}
ORACLES: dict[str, str] = {}
