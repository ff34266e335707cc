import random
import re
from collections import Counter

from pyspark.sql import functions as F

from labspark.llm.op2_mixing import MixParams, mix, mixed_documents, permuted, slots, targets, with_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def levels(sizes, weights, share, cap):
    """Targets by handing the excess on until none is above its cap."""
    total, done = share * sum(sizes), {}
    while True:
        open_ = [i for i in range(len(sizes)) if i not in done]
        left = total - sum(done.values())
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > cap * sizes[i]]
        if not over:
            return [done.get(i, left * weights[i] / weight if weight else 0.0) for i in range(len(sizes))]
        done |= {i: float(cap * sizes[i]) for i in over}


def corpus(seed, n=300):
    rng = random.Random(seed)
    return [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.choice([0, 1, 3, 50, 400]))) + rng.choice(["", "\n", " "]), rng.choice(["a", "b", "é", None, "a", "Z"])) for i in range(n)]


def test_targets_and_taken(docs):
    rows = [*corpus(1), (7, "twice there", "a"), (7, "twice there", "a"), (8, None, "b"), (None, "no id at all", None)]
    got = mix(docs(*rows), MixParams(block=16, shard_slots=64)).collect()
    assert len(got) == len(rows)
    names = sorted({r[2] for r in rows} - {None}) + [None]
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += len(WORD.findall(r[1] or ""))
    want = dict(zip(names, levels([sizes[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2), strict=True))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    by_size = {sizes[n]: n for n in names}
    taken = Counter()
    for r in got:
        name = by_size[r.source_size]
        assert abs(r.target - want[name]) < 1e-6 * max(1, want[name])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[name] += r.taken
    for n in names:
        assert want[n] - 16 <= taken[n] <= want[n] + 1e-6
    again = mix(docs(*rows), MixParams(block=16, shard_slots=64)).collect()
    assert Counter(again) == Counter(got)


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 7, 100):
        got = spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), MixParams(), F.lit(3)).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))


def test_mixed_documents_take_what_mix_counts(docs):
    rows = [r for r in corpus(2, 120) if r[1]]
    p = MixParams(block=16, shard_slots=64)
    want = {r.doc_id: r.taken for r in mix(docs(*rows), p).collect()}
    got = mixed_documents(docs(*rows), p)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    have = Counter()
    texts = {r[0]: WORD.findall(r[1]) for r in rows}
    for r in got.collect():
        have[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text) and set(WORD.findall(r.text)) <= set(texts[r.doc_id])
    assert have == {k: v for k, v in want.items() if v}


def test_no_words(docs):
    assert [(r["size"], r.source_size, r.target, r.taken) for r in mix(docs((1, None), (2, "  "))).collect()] == [(0, 0, 0.0, 0)] * 2
    assert mix(docs()).collect() == []
    assert mixed_documents(docs((1, " "))).collect() == []


def test_slots_of_one_source_are_made_in_many_tasks(docs):
    p = MixParams(block=4, shard_slots=16, task_slots=64)
    table = targets(with_rows(docs(*((i, "word " * 40) for i in range(100)))), p)
    made = slots(table, p).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert sum(r["count"] for r in made) == 1500 and len(made) > 12 and max(r["count"] for r in made) < 300


def test_very_long_texts_and_columns_of_any_name(docs):
    rows = [(1, "a b " * 300_000), (2, "c d"), (2, "c d"), (3, None), (None, "e")]
    table = docs(*rows).withColumnRenamed("lang", "row").withColumnRenamed("n_chars", "runs").withColumn("kept", F.lit(1)).withColumn("tokens", F.lit("t")).withColumn("mixed", F.lit(2.0)).withColumn("idx", F.lit(9))
    got = mixed_documents(table)
    assert got.columns == table.columns
    want = {(r.doc_id, r["size"]): r.taken for r in mix(table).collect()}
    taken = Counter()
    for r in got.collect():
        taken[r.doc_id] += len(WORD.findall(r.text))
        assert (r.row, r.kept, r.tokens, r.mixed, r.idx) == ("en", 1, "t", 2.0, 9)
    assert taken[1] == want[1, 600_000] and abs(sum(taken.values()) - 1.5 * 600_005) < 2
