import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labspark import quantity as qty
from labspark.flow import Dag, Node
from labspark.functions import html, sequence
from labspark.operators import assay, batch, design, enrichment, graph, nca, pk, similarity, structure
from labspark.streaming import plates


def one(spark, expr, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns)).select(expr.alias("r")).first().r if columns else spark.range(1).select(expr.alias("r")).first().r


def test_control_plate(spark):
    rows = [("p", "positive", v, False) for v in (98.0, 100.0, 102.0)] + [("p", "negative", v, False) for v in (8.0, 10.0, 12.0)] + [("p", "positive", 5.0, True), ("q", "positive", 1.0, False)]
    got = {r.plate: r for r in assay.plate_qc(spark.createDataFrame(rows, "plate string, role string, value double, excluded boolean")).collect()}
    assert got["p"].z_prime == pytest.approx(1 - 3 * 4 / 90) and got["p"].signal_to_background == 10 and got["p"].ssmd == pytest.approx(90 / math.sqrt(8))
    assert got["q"].z_prime is None and got["q"].refusal == "fewer than two positive controls"


def test_exponential_series(spark):
    rows = [(s, 0.5 * i, 2 * math.exp(-0.05 * i)) for s in (1, 2) for i in range(97)]
    for parts in (1, 8):  # the split of the rows doesn't matter
        r = nca.nca(spark.createDataFrame(rows, "subject long, t double, c double").repartition(parts), 100.0).filter("subject = 1").first()
        assert [r.lambda_z, r.auc_inf, r.clearance, r.vz, r.mrt, r.half_life] == pytest.approx([0.1, 20, 5, 50, 10, math.log(2) / 0.1], rel=1e-8)
        assert (r.cmax, r.tmax, r.refusal) == (2.0, 0.0, None)
    flat = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 1.0)], "subject long, t double, c double")
    assert nca.nca(flat, 100.0).first().refusal == "no terminal slope"
    twice = spark.createDataFrame([(1, 0.0, 1.0), (1, 0.0, 1.0), (1, 1.0, 0.5)], "subject long, t double, c double")
    assert nca.nca(twice, 100.0).first().refusal == "times do not increase" and nca.nca(twice, 100.0).first().auc_last is None


def test_published_p_values(spark):
    p = [0.0001, 0.0004, 0.0019, 0.0095, 0.0201, 0.0278, 0.0298, 0.0344, 0.0459, 0.3240, 0.4262, 0.5719, 0.6528, 0.7590, 1.0000]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "pathway long, p double")
    q = [r.q for r in enrichment.benjamini_hochberg(rows).orderBy("pathway").collect()]
    assert q[:4] == pytest.approx([0.0015, 0.0030, 0.0095, 0.035625]) and sum(v <= 0.05 for v in q) == 4 and q[-1] == 1
    tail = lambda k, n, m, t: one(spark, enrichment.upper_tail(*(F.lit(v).cast("long") for v in (k, n, m, t))))
    assert tail(2, 3, 5, 10) == pytest.approx(0.5, abs=1e-12) and tail(4, 3, 5, 10) == 0 and tail(0, 3, 5, 10) == 1
    assert one(spark, enrichment.log_factorial(F.lit(170).cast("long"))) == pytest.approx(math.lgamma(171), rel=1e-13)


def test_outliers_and_ranks(spark):
    rows = spark.createDataFrame([("g", v) for v in (1.0, 1.1, 0.9, 1.0, 5.0)] + [("h", 1.0), ("h", 2.0)], "g string, value double")
    got = {r.g: r for r in assay.grubbs(rows, "g").collect()}
    assert got["g"].flagged and got["g"].suspect == 5.0 and not got["h"].flagged and got["h"].statistic is None
    assert {r.g: r.flagged for r in assay.dixon(rows, "g").collect()} == {"g": True, "h": False}
    assert {r.g: r.n_outside for r in assay.tukey_fences(rows, "g").collect()} == {"g": 1, "h": 0}
    ranks = assay.mid_ranks(spark.createDataFrame([("a", v) for v in (1.0, 2.0, 2.0, 3.0)], "g string, value double"), "g")
    assert sorted(r["rank"] for r in ranks.collect()) == [1, 2.5, 2.5, 4]


def test_sequences(spark):
    assert one(spark, sequence.reverse_complement(F.lit("AACGTRYN"))) == "NRYACGTT"
    assert one(spark, sequence.translate(F.lit("ATGGCNTAAG"))) == "MA*" and one(spark, sequence.gc_percent(F.lit("GCSATN"))) == 60 and one(spark, sequence.gc_percent(F.lit("NN"))) == 0
    assert one(spark, sequence.find_pattern(F.lit("AAAA"), "AA")) == [0, 1, 2] and one(spark, sequence.find_pattern(F.lit("GGAC"), "GAN")) == [1]
    assert one(spark, sequence.find_pattern(F.lit("TCGA"), "GATC", circular=True)) == [2] and one(spark, sequence.find_pattern(F.lit("A"), "GATC")) == []
    assert one(spark, sequence.fragments(F.array(F.lit(2), F.lit(6)), 1, F.lit(10))) == [3, 4, 3] and one(spark, sequence.fragments(F.array(F.lit(2), F.lit(6)), 1, F.lit(10), circular=True)) == [4, 6]
    assert one(spark, sequence.longest_run(F.lit("ACCCGTT"))) == 3 and one(spark, sequence.longest_run(F.lit(""))) == 0
    assert one(spark, html.html_to_text(F.lit("<head><title>t</title></head><p>a&amp;lt;b</p><script>x<y</script><!-- n -->c"))) == "a&lt;b c"


def test_structure(spark):
    rng = np.random.default_rng(5)
    p = rng.random((80, 3)) * 4
    atoms = spark.createDataFrame([(i, i % 3, *map(float, x)) for i, x in enumerate(p)], "atom long, chain int, x double, y double, z double")
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    want = {(i, j) for i in range(80) for j in range(80) if i % 3 < j % 3 and d[i, j] <= 0.8}
    assert {(r.atom_1, r.atom_2) for r in structure.contacts(atoms, 0.8).collect()} == want
    turn, _ = np.linalg.qr(rng.standard_normal((3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    for mirror, low in ((1.0, True), (-1.0, False)):
        q = p @ turn.T * np.array([1, 1, mirror]) + 3
        rmsd = structure.superpose(spark.createDataFrame([("g", *map(float, a), *map(float, b)) for a, b in zip(p, q, strict=True)], "g string, x double, y double, z double, mx double, my double, mz double"), "g").first().rmsd
        assert rmsd == pytest.approx(structure.kabsch(p, q)[2], abs=1e-6) and (rmsd < 1e-6) == low
    assert {r.lddt for r in structure.lddt(atoms, atoms, 1.0, (0.5, 1.0)).collect()} == {1.0}


def test_graphs(spark):
    rows = [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 4, 1), (1, 3, 1), (7, 8, 1), (9, 9, 1), (5, 6, 0)]
    edges = spark.createDataFrame(rows, "source long, target long, weight long")
    kept, rejected = graph.clean(edges)
    assert sorted(r.reason for r in rejected.collect()) == ["no evidence", "self-loop"]
    assert {r.node: r.betweenness for r in graph.betweenness(kept).collect()} == {0: 0, 1: 3, 2: 0, 3: 3, 4: 0, 7: 0, 8: 0}
    assert {r.node: r.component for r in graph.components(kept, "source", "target").collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 7: 7, 8: 7}
    chain = spark.createDataFrame([((i * 37) % 200, ((i + 1) * 37) % 200) for i in range(199)], "a long, b long")
    assert {r.component for r in graph.components(chain).collect()} == {0} and graph.components(chain.limit(0)).collect() == []
    middle = spark.createDataFrame([(5, i) for i in range(12) if i != 5] + [(20, 13), (20, 17), (13, 11)], "a long, b long")
    assert sorted((r.node, r.component) for r in graph.components(middle).collect()) == [(i, 0) for i in [*range(12), 13, 17, 20]]
    labels = graph.louvain(kept)
    assert graph.modularity(kept, labels).first().q > 0.2
    with pytest.raises(ValueError):
        graph.betweenness(kept, max_edges=2)


def test_similarity(spark):
    bits = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 2), (3, 9), (4, 7)], "id long, bit long")
    got = [(r.query_id, r.id, r["rank"]) for r in similarity.tanimoto_top_k(bits.filter("id = 1"), bits, 5).orderBy("rank").collect()]
    assert got == [(1, 2, 1), (1, 3, 2)]
    empty = F.array().cast("array<int>")
    assert one(spark, similarity.tanimoto(empty, empty)) == 1


def test_closed_forms(spark):
    lit = lambda v: F.lit(float(v))
    assert one(spark, pk.cheng_prusoff(lit(10), lit(3), lit(1), "competitive")) == 2.5 and one(spark, pk.cheng_prusoff(lit(10), lit(3), lit(1), "mixed")) is None
    assert one(spark, pk.auc_ratio(lit(9), lit(1), lit(0.9))) == pytest.approx(1 / (0.1 * 0.9 + 0.1)) and one(spark, pk.auc_ceiling(lit(1))) is None
    equal, near = (one(spark, pk.bateman(lit(100), lit(1), lit(10), lit(k), lit(0.2), lit(3))) for k in (0.2, 0.2 + 1e-6))
    assert equal == pytest.approx(near, rel=1e-5)


def test_quantities(spark):
    r = spark.range(1).select(qty.quantity(F.lit(3.0), "mg", "model", "fit").alias("a"), qty.quantity(F.lit(None), "mg", "measured", "dose is missing").alias("b"), qty.require(F.lit(None).cast("boolean"), qty.not_computed("x"), "no blank").alias("c"), qty.weakest(F.lit("measured"), F.lit("model")).alias("w")).first()
    assert (r.a.value, r.a.unit, r.a.provenance) == (3, "mg", "model") and (r.b.value, r.b.unit, r.b.provenance) == (None, None, "not_computed") and r.c.source == "no blank" and r.w == "model"
    with pytest.raises(ValueError):
        qty.quantity(F.lit(1.0), "kcal/mol", "heuristic", "guess")


def test_workflows(spark, tmp_path):
    calls = []

    def step(name, fail=False):
        def make(s, inputs):
            calls.append(name)
            if fail:
                raise RuntimeError("broken")
            return s.range(2).selectExpr(f"'{name}' AS name", "id") if not inputs else next(iter(inputs.values())).selectExpr(f"'{name}' AS name", "id")

        return make

    dag = Dag([Node("b", step("b"), ("a",)), Node("a", step("a")), Node("x", step("x", True)), Node("y", step("y"), ("x", "b"))])
    assert dag.order() == ["a", "b", "x", "y"]
    got = dag.run(spark, str(tmp_path))
    assert {k: v.status for k, v in got.items()} == {"a": "done", "b": "done", "x": "failed", "y": "skipped"} and "broken" in got["x"].error
    again = dag.run(spark, str(tmp_path))
    assert again["b"].status == "cached" and calls.count("b") == 1
    changed = Dag([Node("a", step("a"), params="p"), dag.nodes[0]])
    assert changed.keys()["b"] != dag.keys()["b"] and {v.status for v in changed.run(spark, str(tmp_path), cancelled=lambda: True).values()} == {"cancelled", "skipped"}
    for bad in ([Node("a", step("a"), ("a",))], [Node("a", step("a"), ("z",))], [Node("a", step("a"), ("b",)), Node("b", step("b"), ("a",))], [Node("", step("a"))], [Node("a", step("a"))] * 2):
        with pytest.raises(ValueError):
            Dag(bad).validate()


def test_b_score_takes_out_rows_and_columns(spark):
    rng = np.random.default_rng(1)
    rows = [("p", r, c, float(10 * r + 3 * c + rng.normal(0, 0.1) + (50 if (r, c) == (2, 3) else 0))) for r in range(8) for c in range(12)]
    got = batch.b_score(spark.createDataFrame(rows, "plate string, row int, col int, value double")).collect()
    scores = {(r.row, r.col): abs(r.b_score) for r in got}
    assert max(scores, key=scores.get) == (2, 3) and sorted(scores.values())[-2] < 10


def test_streams(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL("subject long, t double, c double")
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, 0.0, 0.0), (1, 2.0, 4.0), (2, 0.0, 1.0)], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in" / "a"))
    spark.createDataFrame([(1, 1.0, 9.0), (1, 3.0, 4.0)], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in" / "b"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    query = plates.running_exposure(stream).writeStream.format("memory").queryName("exposure").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    last = {r.subject: (r.t, r.auc) for r in spark.sql("SELECT * FROM exposure ORDER BY t").collect()}
    assert last[1][0] in (2.0, 3.0) and last[2] == (0.0, 0.0)


def test_superpose_far_from_the_origin(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    p = rng.normal(0, 20, (200, 3)) + [1000.0, -3000.0, 5000.0]
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    q = p @ turn.T + [7.0, 8.0, 9.0]
    rows = [("g", *map(float, a), *map(float, b)) for a, b in zip(p, q, strict=True)] + [("h", *map(float, a), *map(float, b * [1, 1, -1])) for a, b in zip(p, p, strict=True)]
    got = {r.g: r.rmsd for r in structure.superpose(spark.createDataFrame(rows, "g string, x double, y double, z double, mx double, my double, mz double"), "g").collect()}
    assert got["g"] < 1e-10
    assert abs(got["h"] - structure.kabsch(p, p * [1, 1, -1])[2]) < 1e-9


def test_banded_notes_keep_repeats(spark):
    from labspark.operators import catalog_ops

    subjects = spark.createDataFrame([(1, "a", 0.5), (1, "a", 0.5), (2, "a", 9.0), (3, None, 0.5), (4, "b", None)], "id int, gene string, activity double")
    bands = spark.createDataFrame([("a", 0.0, 1.0, 2, "later"), ("a", 0.0, 0.6, 1, "first")], "gene string, low double, high double, seq int, note string")
    got = catalog_ops.banded_notes(subjects, bands, "activity")
    assert got.columns == ["id", "gene", "activity", "note"]
    assert sorted((r.id, r.note) for r in got.collect()) == [(1, "first"), (1, "first"), (2, None), (3, None), (4, None)]


def test_ambiguous_codons(spark):
    from pyspark.sql import functions as F

    from labspark.functions import sequence as seq

    texts = {"GCN": "A", "GCU": "A", "TAR": "*", "TRA": "*", "ATH": "I", "ATN": "X", "YTR": "L", "MGR": "R", "AUG": "M", "NNN": "X", "A-G": "X", "RAY": "X", "GCNTG": "A"}
    df = spark.createDataFrame(list(texts.items()), "s string, want string")
    got = df.select("want", seq.translate(F.col("s")).alias("a"), seq.translated(F.col("s")).alias("b")).collect()
    assert all(r.want == r.a == r.b for r in got), got


def test_precipitation_rate(spark):
    decay = [("a", float(t), 5 + 40 * math.exp(-0.3 * t)) for t in range(8)]
    rows = [*decay, ("b", 0.0, 9.0), ("b", 1.0, 2.0), ("c", 0.0, 9.0), ("c", 1.0, 12.0), ("d", 1.0, 9.0), ("d", 1.0, 8.0), ("e", 0.0, 9.0), ("e", 2.0, 7.0), ("e", 3.0, None)]
    got = {r.k: r for r in design.precipitation_rate(spark.createDataFrame(rows, "k string, t double, c double"), "k", 5.0).collect()}
    assert got["a"].rate == pytest.approx(0.3, rel=1e-12) and got["a"].error < 1e-9
    assert [got[k].missing for k in "abcde"] == [None, "two supersaturated observations", "a decay", "two distinct times", None]
    assert got["e"].rate == pytest.approx(math.log(2) / 2) and got["e"].error == 0


def test_cycle_rank_of_molecules(spark):
    rings = [("naphthalene", a, b) for a, b in [*((i, i + 1) for i in range(9)), (9, 0), (0, 5)]]
    bonds = spark.createDataFrame([*rings, ("naphthalene", 1, 0), ("salt", 0, 1), ("salt", 2, 2), ("salt", None, 1)], "m string, a int, b int")
    atoms = spark.createDataFrame([("naphthalene", i) for i in range(10)] + [("salt", i) for i in range(4)] + [("ion", 0)], "m string, atom int")
    got = {r.m: (r.atoms, r.bonds, r.parts, r.rings) for r in graph.cycle_rank(atoms, bonds, "m").collect()}
    assert got == {"naphthalene": (10, 11, 1, 2), "salt": (4, 1, 3, 0), "ion": (1, 0, 1, 0)}
