"""What showed only on large tables, on small ones that have the same cases."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from labspark import catalog
from labspark.functions.sequence import amino_acid, codons
from labspark.kernels import network
from labspark.operators import alignment_columns, assay, biologics, catalog_ops


def test_tukey_fences_at_zero_and_to_the_last_digit(spark, tmp_path):
    # Quartiles 1.2 and 2.0 have a fence just below 0, which SQL rounds to -0.0; the other plates have shares of a half and quarters.
    def plate(key, *quantities):
        return [(i, 1, key, 4, 50.0 * q, 0.0, 0.0, "N", None) for i, q in enumerate(quantities)]

    rows = plate(1, 0.0, 1.2, 1.5, 2.0, 9.0) + plate(2, 0.0, 1.0, 1.74, 1.76) + plate(3, 0.0, 0.3, 0.7, 0.9, 1.1, 7.0) + plate(4, 5.0) + plate(5, 3.0, 3.0, 3.0, 3.0)
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp"
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    df = catalog.queries()["tukey_fences"](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()['tukey_fences']})").fetchall()
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(map(repr, want))
    assert any("-0.0" in repr(r) for r in want)


def test_quartiles_are_those_of_sql_to_the_last_digit(spark):
    rows = [(g, round((g * 7 + i * i * (g + 3)) % 131 / 50, 2)) for g in range(40) for i in range(4 + g % 9)]
    got = sorted((r.g, r.n, r.q1, r.q3) for r in assay.tukey_fences(spark.createDataFrame(rows, "g long, value double"), "g").collect())
    con = duckdb.connect()
    values = ", ".join(f"({g}, {v!r}::DOUBLE)" for g, v in rows)
    assert got == sorted(con.sql(f"SELECT g, count(*), quantile_cont(v, 0.25), quantile_cont(v, 0.75) FROM (VALUES {values}) t(g, v) GROUP BY g").fetchall())


def test_interactions_count_pairs_in_one_place(spark):
    rng = random.Random(4)
    # Blocks of several members, more enzymes than a slice, members that are on one side alone, repeats, nulls, names as keys.
    a = [(f"m{rng.randrange(60)}", rng.randrange(700)) for _ in range(4000)] + [("only", 1), ("only", None), (None, 1), ("lone", 9999)]
    b = [(f"m{rng.randrange(90)}", rng.randrange(700)) for _ in range(4000)]
    df = catalog_ops.interactions(*(spark.createDataFrame(rows, "member string, enzyme long") for rows in (a, b)))
    want = Counter((p, v) for p, e in set(a) for v, f in set(b) if e == f and None not in (p, e) and p != v)
    got = df.collect()
    assert len(got) == len(want) and {(r.perpetrator, r.victim): r.enzymes for r in got} == want
    # Pairs were exploded by enzyme and shuffled before.
    assert "hashpartitioning(perpetrator" not in df._jdf.queryExecution().executedPlan().toString()
    empty = spark.createDataFrame([], "member string, enzyme long")
    assert catalog_ops.interactions(empty, empty).collect() == []


def test_codons_are_counted_without_a_row_each(spark):
    texts = ["ACGTACGTAAGN", "AC\nGGGTT\r\nACG", "ACé😀TTTGG", "UUUACRXXXACG", "acgACG", "AC", "", None, "GGN CCC"]
    seqs = spark.createDataFrame([(t,) for t in texts], "seq string")
    df = alignment_columns.codon_usage(seqs)
    want = seqs.select(F.explode(codons(F.col("seq"))).alias("codon")).withColumn("aa", amino_acid(F.col("codon"))).filter("aa IS NOT NULL").groupBy("codon", "aa").count()
    assert sorted((r.codon, r.aa, r.n) for r in df.collect()) == sorted((r.codon, r.aa, r["count"]) for r in want.collect())
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()


def test_profiles_of_many_subjects_at_once():
    rng = random.Random(8)
    rows = [(rng.uniform(1, 200), rng.uniform(5, 60), rng.uniform(0.5, 9), rng.choice([math.nan, 0.0, 0.3, 1.1, 4.0])) for _ in range(200)] + [(math.nan, 20.0, 1.0, 1.0), (100.0, math.nan, 1.0, math.nan)]
    times = np.array([4.0, 0.0, 1.03, 12.0])
    got = network.simulate_pk_rows(times, *np.array(rows).T, step=0.05)
    want = [network.simulate_pk(times, [network.Dose(0.0, d)], v, cl, None if math.isnan(ka) else ka, step=0.05) for d, v, cl, ka in rows]
    assert np.array_equal(got, np.array(want), equal_nan=True)
    assert network.simulate_pk_rows(times, *np.zeros((4, 0)), step=0.05).shape == (0, 4)


def test_bonds_by_blocks_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(biologics, "BLOCK", 16)
    rng = random.Random(12)
    rows = [(i, *(rng.uniform(-3, 3) for _ in range(3)), rng.choice([0.3, 0.5, 0.7])) for i in range(300)] + [(5, 0.0, 0.0, 0.0, 0.5), (900, None, 0.0, 0.0, 0.5), (901, math.nan, 0.0, 0.0, 0.5), (None, 0.0, 0.0, 0.0, 0.5)]
    df = biologics.inferred_bonds(spark.createDataFrame(rows, "atom long, x double, y double, z double, covalent double"))
    good = [r for r in rows if None not in r]
    pairs = [(a[0], b[0], math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2), a[4] + b[4] + 0.45) for a in good for b in good if a[0] < b[0]]
    assert sorted((r.atom_1, r.atom_2, round(r.distance, 9)) for r in df.collect()) == sorted((a, b, round(d, 9)) for a, b, d, most in pairs if 0.4 < d <= most)
    # Rows of atoms were copied to 27 cells and sorted there before.
    assert "atom_2" not in df._jdf.queryExecution().optimizedPlan().toString().split("\n", 1)[1]


def test_bonds_of_copies_come_in_runs(spark, monkeypatch):
    monkeypatch.setattr(biologics, "BLOCK", 64)
    rng = random.Random(13)
    places = [tuple(rng.uniform(0, 2) for _ in range(3)) for _ in range(30)]
    rows = [(i + 30 * k, *p, 0.5) for k in range(20) for i, p in enumerate(places)]
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        got = biologics.inferred_bonds(spark.createDataFrame(rows, "atom long, x double, y double, z double, covalent double")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    pairs = [(a[0], b[0], math.dist(a[1:4], b[1:4])) for a in rows for b in rows if a[0] < b[0]]
    assert sorted((r.atom_1, r.atom_2, round(r.distance, 9)) for r in got) == sorted((a, b, round(d, 9)) for a, b, d in pairs if 0.4 < d <= 1.45)
    # Output files, which grow with the square, held like distances apart before and took more room.
    changes = sum(abs(a.distance - b.distance) > 1e-9 for a, b in zip(got, got[1:], strict=False))
    assert changes < len(got) / 3
