"""Results don't depend on how rows are split or ordered."""

import pytest
from pyspark.sql import functions as F

from labspark.operators import alignment_columns, assay, biologics, catalog_ops, enrichment, graph, nca, pk, protein, similarity, structure
from labspark.plans import views

SF = "/root/testdata/sf0.001"


def _sets(s, cut):
    return tuple(cut(d) for d in views.gene_sets(s, SF))


def _seqs(s, cut):
    return cut(views.sequences(s, SF).select("doc_id", "lang", "seq"))


def _bits(s, cut):
    items = s.read.parquet(f"{SF}/lineitem.parquet")
    return cut(items.select(F.col("l_suppkey").alias("id"), (F.col("l_partkey") % 31).alias("bit")).distinct())


CASES = {
    "plate_qc": lambda s, cut: assay.plate_qc(cut(views.wells(s, SF))),
    "normalise": lambda s, cut: assay.normalise(cut(views.wells(s, SF))),
    "kruskal": lambda s, cut: assay.kruskal_wallis(assay.included(cut(views.wells(s, SF))), "plate", "col"),
    "tukey": lambda s, cut: assay.tukey_fences(assay.included(cut(views.wells(s, SF))), "plate"),
    "nca": lambda s, cut: nca.nca(cut(views.concentrations(s, SF)), 100.0),
    "occupancy": lambda s, cut: pk.time_above(cut(views.concentrations(s, SF)), 10.0),
    "enrich": lambda s, cut: enrichment.enrich(*_sets(s, cut)),
    "tanimoto": lambda s, cut: similarity.tanimoto_top_k(_bits(s, cut), _bits(s, cut), 3),
    "contacts": lambda s, cut: structure.contacts(cut(views.points(s, SF)), 0.1).select("atom_1", "atom_2", "d2"),
    "surface": lambda s, cut: protein.surface(cut(views.points(s, SF)).limit(10**9).withColumns({"x": F.col("x") * 20, "radius": F.lit(1.7)})),
    "bonds": lambda s, cut: biologics.inferred_bonds(cut(views.points(s, SF)).withColumn("covalent", F.lit(0.4)), 0.0),
    "degree": lambda s, cut: graph.degree(cut(views.trade_edges(s, SF))),
    "components": lambda s, cut: graph.components(cut(views.trade_edges(s, SF).filter("weight % 9 = 0")), "source", "target"),
    "louvain": lambda s, cut: graph.louvain(cut(views.trade_edges(s, SF))),
    "entropy": lambda s, cut: alignment_columns.column_entropy(_seqs(s, cut).select("lang", F.substr("seq", F.lit(1), F.lit(40)).alias("row")), "lang"),
    "usage": lambda s, cut: alignment_columns.codon_usage(_seqs(s, cut)),
    "overlay": lambda s, cut: catalog_ops.overlay(cut(s.read.parquet(f"{SF}/orders.parquet").select(F.col("o_custkey").alias("pack_id"), F.col("o_orderkey").alias("load_seq"), "o_orderstatus"))),
}


def rows(df):
    return sorted(repr(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r)) for r in df.collect())


@pytest.mark.parametrize("name", CASES)
def test_split_and_order(spark, name):
    one = rows(CASES[name](spark, lambda df: df.coalesce(1)))
    many = rows(CASES[name](spark, lambda df: df.repartition(8, F.rand(3))))
    assert one == many and one
