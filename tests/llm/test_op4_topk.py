import math
import random
import warnings

import numpy as np

from labspark.llm.op4_topk import HIGHEST, LOWEST, TopKParams, messages, packed_type, scores, top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    good = [(i, [math.floor(256.0 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in sorted({i: min(v for j, v in good if j == i) for i, _ in good if i % 5 == 0}.items()):
        scored = sorted((-max(LOWEST, min(HIGHEST, sum(a * b for a, b in zip(qv, v, strict=False)))), i) for i, v in good if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


def check(spark, rows, **params):
    got = top_k(spark.createDataFrame(rows, SCHEMA), lambda v: v % 5 == 0, TopKParams(**params))
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute(rows, params.get("k", 5))


def test_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)], 0) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8, 0) for i in range(100)]  # ties
    rows += [(2000, None, 0), (2005, [1.0] * 7 + [None], 0), (2010, [float("nan")] * 8, 0), (2015, [float("inf")] * 8, 0), (None, [9.0] * 8, 0), (7, [0.25] * 8, 0)]
    check(spark, rows, sample=50, pivots=6, annuli=4, data_block=32, query_block=8)


def test_few_and_large(spark):
    check(spark, [(0, [1.0, 2.0], 0), (5, [3.0, -1.0], 0)])
    check(spark, [(0, [1.0], 0)])
    check(spark, [(i, [1e6 * i, -3e6], 0) for i in range(12)], sample=4, pivots=2)
    assert top_k(spark.createDataFrame([], SCHEMA), lambda v: v % 5 == 0).collect() == []


def test_scores_near_and_beyond_the_range_of_a_long(spark):
    rng = random.Random(5)
    for size in (1e4, 9e5, 3e6, 2e7, 1e12, 3e38):
        rows = [(i, [rng.uniform(-size, size) for _ in range(6)], 0) for i in range(60)] + [(100 + i, [size] * 6, 0) for i in range(3)] + [(110, [-size] * 6, 0), (111, [0.0] * 6, 0)]
        check(spark, rows, sample=20, pivots=4, annuli=4, data_block=8, query_block=4, key_blocks=1)


def test_products_are_exact_at_any_size():
    rng = random.Random(6)
    for bits in (10, 26, 40, 62, 130, 300):
        q, x = ([[float(rng.randint(-(1 << bits), 1 << bits)) for _ in range(9)] for _ in range(n)] for n in (4, 7))
        want = [[max(LOWEST, min(HIGHEST, sum(int(a) * int(b) for a, b in zip(u, v, strict=True)))) for v in x] for u in q]
        assert scores(np.array(q), np.array(x), max(abs(c) for v in q + x for c in v)).tolist() == want


def test_no_warnings_and_columns_of_any_name(spark):
    rows = [(i, [float(i), 1.0], i) for i in range(20)]
    table = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("label", "cell")
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        assert top_k(table, lambda v: v % 5 == 0).count() == 20


def test_messages_are_bounded_and_packed_exactly(spark):
    rows = [(i, bytes(8), bytes(1000)) for i in range(100)]
    got = list(messages(iter(rows), most=10_000))
    assert len(got) == 10 and max(b.nbytes for b in got) < 13_000
    assert [r for b in got for r in b.column("cell").to_pylist()] == list(range(100))
    for largest, kind in ((127, "i1"), (128, "i2"), (32768, "i4"), (1 << 31, "f8")):
        assert packed_type(float(largest)) == np.dtype(kind)
        x = [largest / 256, -largest / 256]
        check(spark, [(i, [x[i % 2], x[i // 2 % 2]], 0) for i in range(20)], sample=4, pivots=2, data_block=3)


def test_a_query_meets_many_keys(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)], 0) for i in range(300)]
    check(spark, rows, sample=20, pivots=16, annuli=16, data_block=2, query_block=4, key_blocks=1)
    check(spark, rows + [(300 + i, [], 0) for i in range(5)], sample=20, pivots=4, annuli=4, data_block=2, query_block=4, key_blocks=1)


def test_blocks_are_joined_without_a_broadcast(spark):
    rng = random.Random(10)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)], 0) for i in range(200)]
    df = top_k(spark.createDataFrame(rows, SCHEMA), lambda v: v % 5 == 0, TopKParams(sample=20, pivots=4, annuli=4, data_block=16, query_block=8))
    assert sorted(tuple(r) for r in df.collect()) == brute(rows, 5)
    # Spark broadcast one side before, whose real size its estimate doesn't know, and large tables ran out of memory.
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
