import os
import re
from collections import Counter

import corpus_pipeline
import duckdb
import pytest

import __spark_entry__
from labspark.llm import op2_mixing, op6_jaccard
from labspark.llm.op3_packing import PackParams, encoder
from labspark.session import materialise

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    """Each stage over sf0.001, against what its decisions mean."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialise(stage(spark, kept[-1], SF), "test-" + name.replace(" ", "-")))
    assert all(k.columns == columns for k in kept[:-1])
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept[:-1]]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    queries = __spark_entry__.queries()
    predicted = {r.doc_id for r in queries["op8_quality_classifier"](spark, SF).filter("predicted = 1").collect()}
    assert ids[1] == predicted
    leaked = {r.doc_id for r in queries["op7_benchmark_decontamination"](spark, SF).filter("contaminated").collect()}
    assert ids[3] == ids[2] - leaked
    # Near copies: the smallest id of each component over the stage's own input stays.
    found = op6_jaccard.jaccard_components(kept[1]).collect()
    assert ids[2] == {r.doc_id for r in found if r.doc_id == r.component_id}
    assert ids[2] == smallest_of_groups(kept[1])
    # Mixing: the words in the texts are those that the operator takes, document by document.
    taken = {r.doc_id: r.taken for r in op2_mixing.mix(kept[3]).collect()}
    words = Counter()
    for r in kept[4].collect():
        words[r.doc_id] += len(re.findall(op2_mixing.WORD, r.text))
    assert words == {k: v for k, v in taken.items() if v}
    enc, want = encoder(PackParams().ranks), Counter()
    for r in kept[4].collect():
        want[r.doc_id] += len(enc.encode_ordinary(r.text)) + 1
    have = Counter()
    for r in kept[5].collect():
        for doc, a, b in zip(r.doc_ids, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            have[doc] += b - a
    assert have == want
    assert corpus_pipeline.run(spark, SF).count() == kept[5].count()


def smallest_of_groups(docs):
    """Ids that are the smallest of their group, by comparing all pairs of sets of five-word shingles."""
    sets = {}
    for r in docs.collect():
        lower = (r.text or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall(op2_mixing.WORD, lower)
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    order = sorted(sets)
    group = {i: i for i in order}
    for at, a in enumerate(order):
        for b in order[at + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and 10 * small >= 8 * large and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {k: low if v == high else v for k, v in group.items()}
    return {i for i in order if group[i] == i}


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, row int, kept int, `a.b` string, size int, score double, leaks string, component_id int"


@pytest.mark.parametrize("at", range(5))
def test_stages_on_awkward_tables(spark, at):
    """Nulls everywhere, empty and long texts, repeats, an empty table, names that the operators use themselves."""
    name, stage = corpus_pipeline.STAGES[at]
    assert stage(spark, spark.createDataFrame([], AWKWARD), SF).collect() == []
    long = "the quiet river went past the old stone house and on. " * 20_000
    texts = {1: "The quiet river went past the old house in the morning light.", 2: None, 3: "", 4: long, None: "Nobody numbered this small text about gardens.", 6: " \n\t ", 7: None}
    rows = [(k, t, None if k == 7 else "en", None if k in (4, 7) else "a", len(t or ""), 1, 2, "x", 3, 0.5, "y", 4) for k, t in texts.items()]
    table = spark.createDataFrame([*rows, rows[0], rows[3], (None,) * 12], AWKWARD)
    got = stage(spark, table, SF)
    if name == "token-ID output":
        enc = encoder(PackParams().ranks)
        assert sum(r.n_tokens for r in got.collect()) == sum(len(enc.encode_ordinary(r.text or "")) + 1 for r in table.collect())
        return
    assert got.columns == table.columns
    out = [tuple(r) for r in got.collect()]
    given = Counter(tuple(r) for r in table.collect())
    if name == "mixing sources to target weights":
        assert {r[0] for r in out} <= {1, 4, None} and all(r[1] and r[4] == len(r[1]) and (r[3] is None) == (r[0] == 4) for r in out)
        return
    counts = Counter(out)
    assert all(counts[r] <= given[r] for r in counts)
    if name == "n-gram Jaccard join":
        assert counts == Counter(dict.fromkeys(given, 1))
    if name == "benchmark decontamination":
        assert counts == given
    if name == "quality classifier":
        assert all(counts[r] == given[r] for r in counts)


def test_every_operator_has_its_query():
    names = __spark_entry__.queries()
    assert all(sum(q.startswith(f"op{n}_") for q in names) == 1 for n in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if n.startswith("op")))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    relation = con.sql(__spark_entry__.oracle_sql()[name])
    want = sorted(repr(tuple(dict(zip(relation.columns, r, strict=True))[c] for c in columns)) for r in relation.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want
