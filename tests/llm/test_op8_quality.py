import random
import zlib

import numpy as np
import pyarrow as pa

from labspark.llm.op8_quality import QualityParams, accepted, features, fit, quality


def corpus(n=400):
    rng = random.Random(8)
    words = ["the", "of", "and", "river", "stone", "quiet", "morning", "letter", "window", "garden"]
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        w = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        rows.append((i, " ".join(w) + "." if good else " ".join(x.upper() + rng.choice(["!!", "$$$", "###"]) for x in w)))
        labels.append((i, int(good), rng.randint(0, 1)))
    return rows, labels


def test_held_out_accuracy(spark, docs):
    rows, labels = corpus()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    extra = [(1000, None), (1001, ""), (None, "the river and the stone.")]
    got = quality(docs(*rows, *extra, rows[0]), table).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


def test_held_out_labels_are_never_used(spark, docs):
    rows, labels = corpus(120)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels]
    scores = [sorted((r.doc_id, r.score) for r in quality(docs(*rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_blocked_products_equal_brute_force(spark, docs):
    rows, labels = corpus(150)
    model = fit(docs(*rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), QualityParams(block=7))
    x = features(pa.array([t for _, t in rows]), model.params.buckets)
    got = model.score(x)
    for i, v in enumerate(model.project(x)):
        near = (model.vectors @ v).astype(float)
        votes = near >= np.sort(near)[-15] - 1e-6
        assert np.isclose(got[i], (near.clip(0) * model.labels)[votes].sum() / near.clip(0)[votes].sum(), atol=1e-6)
    turned = model.score(x[::-1])[::-1]
    assert np.allclose(got, turned, atol=1e-6)


def test_ties_vote_together(spark, docs):
    """Twenty copies of one labelled text tie at the fifteenth place: all of them vote."""
    rows = [(i, "the quiet river and the stone garden") for i in range(20)] + [(20 + i, "XX!! YY$$ ZZ##") for i in range(20)]
    labels = [(i, int(i >= 5)) for i in range(20)] + [(20 + i, 0) for i in range(20)]
    model = fit(docs(*rows), spark.createDataFrame(labels, "doc_id long, quality int"))
    got = model.score(features(pa.array([rows[0][1]]), model.params.buckets))
    assert np.isclose(got[0], 0.75, atol=1e-6)


def test_held_out_auc_on_whole_labels(spark):
    """Rank statistic and accuracy over the held-out rows of the driver's table."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality(spark.read.parquet(f"{sf}/documents.parquet"), labels).filter("held_out")
    rows = got.join(labels.select("doc_id", "quality"), "doc_id").collect()
    good = np.array([r.score for r in rows if r.quality == 1])
    bad = np.array([r.score for r in rows if r.quality == 0])
    auc = ((good[:, None] > bad).sum() + 0.5 * (good[:, None] == bad).sum()) / (len(good) * len(bad))
    accuracy = np.mean([r.predicted == r.quality for r in rows])
    print(f"{len(rows)} held-out rows, AUC {auc:.5f}, accuracy {accuracy:.4f}")
    assert len(good) > 1000 and len(bad) > 100 and auc > 0.999 and accuracy > 0.97


def test_no_labels_and_empty_tables(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality(docs((1, "a"), (2, None)), none).collect()] == [0.5, 0.5]
    odd = spark.createDataFrame([(None, 1, 0), (1, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality(docs((1, "a")), odd).collect()] == [0.5]
    assert quality(docs(), none).collect() == []


def test_accepted_keeps_columns(spark, docs):
    rows, labels = corpus(150)
    table = docs(*rows).withColumnRenamed("lang", "score")
    model = fit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = accepted(table, model)
    assert got.columns == ["doc_id", "text", "score", "source", "n_chars"]
    assert {r.doc_id for r in got.collect()} == {i for i, q, _ in labels if q}
    assert accepted(docs(*rows), model).count() == got.count()
