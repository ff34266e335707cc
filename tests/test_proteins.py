import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labspark import registry
from labspark.operators import batch, catalog_ops, design, protein


def test_digest(spark):
    df = spark.createDataFrame([("a", "MKRPAKWWRDE"), ("b", ""), ("c", None)], "id string, seq string")
    got = sorted((r.id, r.start, r.missed, r.peptide) for r in protein.digest(df, "id", "seq", missed=1, min_length=1).collect())
    assert got == [("a", 0, 0, "MK"), ("a", 0, 1, "MKRPAK"), ("a", 2, 0, "RPAK"), ("a", 2, 1, "RPAKWWR"), ("a", 6, 0, "WWR"), ("a", 6, 1, "WWRDE"), ("a", 9, 0, "DE")]
    mass = spark.createDataFrame([("GG",), ("GX",)], "p string").select(protein.peptide_mass(F.col("p")).alias("m")).collect()
    assert mass[0].m == pytest.approx(2 * 57.02146 + 18.01056) and mass[1].m is None


def test_oligo(spark):
    rows = spark.createDataFrame([("GCGAATTCGC",), ("ACGTN",), ("A",)], "o string").select(*(c.alias(k) for k, c in protein.oligo_thermo(F.col("o"), sodium=1.0).items())).collect()
    # GC CG GA AA AT TT TC CG GC, two GC ends, symmetric.
    dh = -9.8 - 10.6 - 8.2 - 7.9 - 7.2 - 7.9 - 8.2 - 10.6 - 9.8 + 0.2
    ds = -24.4 - 27.2 - 22.2 - 22.2 - 20.4 - 22.2 - 22.2 - 27.2 - 24.4 - 5.6 - 1.4
    assert rows[0].dh == pytest.approx(dh) and rows[0].ds == pytest.approx(ds) and rows[0].tm == pytest.approx(1000 * dh / (ds + 1.9872 * math.log(2.5e-7)) - 273.15)
    assert rows[1].tm is None and rows[2].tm is None


def test_surface_of_one_and_two_carbons(spark):
    atoms = lambda *x: spark.createDataFrame([(i, float(v), 0.0, 0.0, 1.7) for i, v in enumerate(x)], "atom long, x double, y double, z double, radius double")
    assert protein.surface(atoms(0)).first().area == pytest.approx(120.762822, abs=1e-6)
    assert [r.area for r in protein.surface(atoms(0, 50)).collect()] == pytest.approx([120.762822] * 2, abs=1e-6)
    # A cap of height r - d / 2 is covered; 92 points tell it to a few per cent.
    near = protein.surface(atoms(0, 2)).collect()
    assert all(r.area == pytest.approx(4 * math.pi * 3.1**2 * (1 - (3.1 - 1) / 6.2), rel=0.05) for r in near)
    assert protein.surface(atoms()).collect() == []


def test_torsions(spark):
    helix = []
    for i in range(4):
        p = [(math.cos(t), math.sin(t), 0.5 * t) for t in (i * 3 + k for k in range(3))]
        helix.append(("A", i, "", *p))
    df = spark.createDataFrame(helix, "chain string, auth_seq int, icode string, n struct<x: double, y: double, z: double>, ca struct<x: double, y: double, z: double>, c struct<x: double, y: double, z: double>")
    got = protein.torsions(df).orderBy("auth_seq").collect()

    def want(points):
        p = np.array(points)
        b = np.diff(p, axis=0)
        n1, n2 = np.cross(b[0], b[1]), np.cross(b[1], b[2])
        return math.degrees(math.atan2(np.cross(n1, n2) @ b[1] / np.linalg.norm(b[1]), n1 @ n2))

    flat = [p for r in helix for p in r[3:]]
    assert got[0].phi is None and got[3].psi is None
    assert [r.phi for r in got[1:]] == pytest.approx([want(flat[3 * i - 1 : 3 * i + 3]) for i in range(1, 4)])
    assert [r.psi for r in got[:3]] == pytest.approx([want(flat[3 * i : 3 * i + 4]) for i in range(3)])


def test_conservation_and_vina(spark):
    rows = spark.createDataFrame([(f"h{i}", "A" + ("C" if i % 2 else "-")) for i in range(16)], "row string, sequence string")
    got = {r.column: r for r in protein.conservation(rows, "h1").collect()}
    assert got[0].entropy == 0 and got[1].gap_fraction == 0.5 and got[1].residue == "C" and got[0].usable
    assert not protein.conservation(rows.limit(5), "h1").first().usable
    lines = spark.createDataFrame([(0, "MODEL 1"), (1, "REMARK VINA RESULT:    -7.5      0.000      0.000"), (2, "REMARK VINA RESULT: -7.1 1.2 2.3")], "line_no int, value string")
    assert [tuple(r) for r in protein.vina_results(lines).orderBy("pose").collect()] == [(1, -7.5, 0.0, 0.0), (2, -7.1, 1.2, 2.3)]


def test_design(spark):
    assert [r.conc for r in design.serial_dilution(spark, 100.0, 10, 3).orderBy("step").collect()] == [100, 10, 1]
    with pytest.raises(ValueError):
        design.serial_dilution(spark, 1.0, 1, 3)
    grid = 10.0 ** np.linspace(-9, -5, 17)
    ladder, best = design.d_optimal(grid, np.array([100, 1, -7, 0.0]), 6)
    from labspark.kernels import fit

    even = fit.jacobian(fit.logistic4, np.linspace(-9, -5, 6), np.array([100, 1, -7, 0.0]))
    assert len(ladder) == 6 and best >= np.linalg.slogdet(even.T @ even)[1]
    runs = design.simulate_fits(spark, [10.0 ** (-9 + 0.4 * i) for i in range(11)], [100, 1, -7, 0], 2.0, 200, 1).toPandas()
    assert 0.89 <= runs.covered.mean() <= 0.99
    line = spark.createDataFrame([("g", float(i), float(i * i)) for i in range(12)], "g string, x double, y double")
    dy = {r.x: r.dy for r in design.savitzky_golay(line, "g", "x", "y").collect()}
    assert dy[5.0] == pytest.approx(10) and dy[0.0] is None
    uneven = spark.createDataFrame([("g", float(i**2), 1.0) for i in range(12)], "g string, x double, y double")
    assert all(r.dy is None for r in design.savitzky_golay(uneven, "g", "x", "y").collect())
    terms = [("ok", -1.0, {"C": 1.0}), ("ok", 1.0, {"C": 1.0}), ("off", 1.0, {"C": 2.0}), ("unknown", 1.0, None)]
    got = {r.reaction: (r.balanced, r.unbalanced, r.missing) for r in design.element_balance(spark.createDataFrame(terms, "reaction string, coefficient double, composition map<string, double>")).collect()}
    assert got == {"ok": (True, [], 0), "off": (False, ["C"], 0), "unknown": (False, [], 1)}
    p = spark.createDataFrame([(1.959963984540054, 3.841458820694124, 1), (0.0, None, 1)], "z double, h double, k int").select(design.p_two_sided(F.col("z")).alias("a"), design.p_chi2(F.col("h"), F.col("k")).alias("b")).collect()
    assert p[0].a == pytest.approx(0.05) and p[0].b == pytest.approx(0.05) and p[1].a == 1 and p[1].b is None


def test_catalogs(spark):
    targets = spark.createDataFrame([(1, "Alpha one", 1), (2, "alpha", 2), (3, "Beta", 3)], "id long, name string, seq long")
    wanted = spark.createDataFrame([("ALPHA",), ("al",), ("3",), ("zz",)], "text string")
    got = {r.text: (r.id, r.exact) for r in catalog_ops.resolve(targets, wanted).collect()}
    assert got == {"ALPHA": (2, True), "al": (1, False), "3": (3, True), "zz": (None, None)}
    catalog = spark.createDataFrame([(1, "50% off", "x", 2), (2, "plain", "Y", 1)], "id long, name string, class string, seq long")
    assert [r.id for r in catalog_ops.search(catalog, "%").collect()] == [1] and [r.id for r in catalog_ops.search(catalog, "y").collect()] == [2]


def test_bad_molecules_keep_their_rows(spark):
    df = spark.createDataFrame([(1, "CCO"), (2, "C("), (3, None)], "id long, smiles string")
    got = {r.id: r.props for r in batch.smiles_props(df).collect()}
    assert got[1].formula == "C2H6O" and got[2].formula is None and got[2].error and got[3].error
    hits = {r.id: r.hits for r in batch.smarts_hits(df, {"o": "[OX2]"}).collect()}
    assert hits == {1: {"o": 1}, 2: None, 3: None}
    with pytest.raises(Exception, match="not supported"):
        batch.smarts_hits(df, {"bad": "[Qq]"})


def test_registry(spark):
    assert all(callable(registry.resolve(n)) for n in registry.ALIASES)
    with pytest.raises(KeyError):
        registry.resolve("nothing")
    registry.register_sql(spark)
    r = spark.sql("SELECT canonical_smiles('OCC') AS a, exact_mass('H2O') AS b, alignment_score('MKV', 'MKV') AS c, canonical_smiles('C(') AS d").first()
    assert r.a == "CCO" and r.b == pytest.approx(18.010565, abs=1e-5) and r.c == 14 and r.d is None


def test_orfs(spark):
    import random

    from labspark.functions.sequence import reverse_complement_text

    rng = random.Random(2)
    for circular in (False, True):
        for _ in range(30):
            s = "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 90)))
            n, want = len(s), set()
            for strand, t in (("+", s), ("-", reverse_complement_text(s))):
                for a in range(n):
                    room = n if circular else n - a
                    codons = ["".join(t[(a + i + j) % n] for j in range(3)) for i in range(0, room - 2, 3)]
                    if not codons or codons[0] != "ATG":
                        continue
                    stop = next((i for i, c in enumerate(codons) if c in ("TAA", "TAG", "TGA")), None)
                    if circular and stop is None:
                        continue
                    aa = len(codons) if stop is None else stop
                    b = a + 3 * (aa + (stop is not None))
                    start, end = (a, b) if strand == "+" else (n - b, n - a)
                    if start < 0:
                        start, end = start + n, end + n
                    if aa >= 3:
                        want.add((strand, start, end, aa, stop is not None))
            got = {o for o in batch.find_orfs(s, 3, circular) if o[4] or not circular}
            assert got == want
    df = spark.createDataFrame([(1, "ATG" + "GCA" * 40 + "TAA"), (2, None)], "id long, seq string")
    best = batch.orfs(df, "id", "seq").orderBy(F.col("aa").desc()).first()
    assert (best.id, best.strand, best.start, best.stop, best.aa, best.has_stop) == (1, "+", 0, 126, 41, True)
