import random
from collections import Counter

import duckdb
import pandas as pd

from labspark.llm.op5_lines import LineParams, dedup_lines
from labspark.llm.queries import LINES_SQL

PASSAGE = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))


def run(df, **p):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in dedup_lines(df, LineParams(**p)).collect()}


def test_recurring_passages_go_and_the_rest_stays_in_order(docs):
    got = run(docs((1, f"first own line here\n{PASSAGE}\nlast"), (2, f"{PASSAGE}\nanother own line here"), (3, "clean text of its own"), (4, None), (5, ""), (6, f"  {PASSAGE.replace(' ', '  ')} ")))
    assert got[1] == (3, 1, "first own line here\nlast")
    assert got[2] == (2, 1, "another own line here")
    assert got[3] == (1, 0, "clean text of its own")
    assert got[4] == (0, 0, None) and got[5] == (1, 0, "") and got[6] == (1, 1, "")


def test_variable_fields_generalise(docs):
    line = "the server at port {} was restarted by user {} after the nightly backup had been done"
    got = run(docs(*((i, line.format(i * 17, "user" + "abcdefgh"[i]) + f"\nown words of document {'xyzuvwrs'[i]}") for i in range(8))))
    assert all(n == 1 and "restarted" not in t for _, n, t in got.values())
    other = "the server at {} ends here and this goes on in quite another way for number {}"
    words = ["alpha beta", "gamma delta", "eps zeta"]
    got = run(docs(*((i, f"same three words {w} " + " ".join(f"{c}{w[0]}" for c in "abcdefghij")) for i, w in enumerate(words))), constant=0.5)
    assert all(n == 0 for _, n, _ in got.values()), other


def test_short_lines_need_many_documents(docs):
    few = run(docs(*((i, "all rights reserved\nx" + chr(97 + i)) for i in range(9))))
    many = run(docs(*((i, "all rights reserved\nx" + chr(97 + i)) for i in range(10))))
    assert all(n == 0 for _, n, _ in few.values()) and all(n == 1 for _, n, _ in many.values())


def test_repeated_rows_are_one_document(docs):
    got = dedup_lines(docs((1, PASSAGE), (1, PASSAGE))).collect()
    assert [(r.doc_id, r.n_dropped) for r in got] == [(1, 0), (1, 0)]
    assert dedup_lines(docs()).collect() == []


def by_sql(rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64", "text": "string"}))
    return Counter(con.execute(f"SELECT doc_id, n_lines, n_dropped, text FROM ({LINES_SQL})").fetchall())


def test_repeats_of_rows_agree_with_sql(docs):
    shared = "one two three four five six seven eight nine ten eleven\nsecond shared line of more than ten words is a line to drop"
    rows = [(1, shared), (1, shared), (1, shared), (2, shared), (3, "own line of this one document"), (3, None), (4, "")]
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in dedup_lines(docs(*rows)).collect())
    assert got == by_sql(rows) and got[1, 2, 2, ""] == 3


def test_random_lines_agree_with_sql(docs):
    rng = random.Random(11)
    pool = [" ".join(rng.choice(["a", "bb", "ccc", "d4", "5", "e"]) for _ in range(rng.randint(1, 14))) for _ in range(60)]
    rows = []
    for i in range(80):
        text = "\n".join(rng.choice(pool) if rng.random() < 0.7 else rng.choice(["", "  x  y z ", "\tq r s"]) for _ in range(rng.randint(0, 8)))
        rows += [(i, text if rng.random() < 0.95 else None)] * rng.choice([1, 1, 1, 3])
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in dedup_lines(docs(*rows)).collect())
    assert got == by_sql(rows)


def test_very_long_texts_and_columns_of_any_name(docs):
    long = "\n".join([f"line of the very long text {'xyz'[i % 3] * (i % 50 + 1)} {'abc'[i % 3] * (i // 3 % 211 + 1)}" for i in range(20_000)]) + "\n" + PASSAGE + "\n" + "x" * 1_000_000
    table = docs((1, long), (2, PASSAGE)).withColumnRenamed("lang", "line").withColumnRenamed("source", "doc").withColumnRenamed("n_chars", "lost")
    got = {r.doc_id: (r.n_lines, r.n_dropped, len(r.text)) for r in dedup_lines(table).collect()}
    assert got == {1: (20_002, 1, len(long) - len(PASSAGE) - 1), 2: (1, 1, 0)}
