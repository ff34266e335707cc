import random

import numpy as np
import pytest

from labspark.llm.op10_licenses import TEMPLATES, align, scan_licenses, winnow


def found(docs, *rows, **kw):
    return {r.doc_id: [(h.license, round(h.coverage, 3)) for h in r.licenses] for r in scan_licenses(docs(*rows), **kw).collect()}


def test_whole_templates_are_found_where_they_are(docs):
    rows = [(i, f"Prose before, of no account.\n{t}\nAnd after é.") for i, t in enumerate(TEMPLATES.values())]
    got = scan_licenses(docs(*rows)).collect()
    for (name, text), r in zip(TEMPLATES.items(), sorted(got, key=lambda r: r.doc_id), strict=True):
        hit = [h for h in r.licenses if h.license == name]
        assert len(hit) == 1 and hit[0].coverage == 1.0
        whole = rows[r.doc_id][1].encode()[hit[0].first_byte : hit[0].end_byte].decode()
        assert text.startswith(whole) and text[len(whole) :].strip("./") == ""


def test_edits_case_and_clean_text(docs):
    header = TEMPLATES["GPL-3.0-header"].split()
    edited = " ".join(["THIS", "PROGRAM", "is", *header[3:10], "freely", *header[10:20], *header[21:]])
    got = found(docs, (1, edited), (2, "All the rights of the reserved seats"), (3, None), (4, ""), (5, "All rights reserved. x All Rights Reserved"), (6, " ".join(header[: len(header) // 2])))
    assert [n for n, _ in got[1]] == ["GPL-3.0-header"] and 0.9 < got[1][0][1] < 1
    assert got[2] == got[3] == got[4] == got[6] == [] and [n for n, _ in got[5]] == ["all-rights-reserved"] * 2


def test_closer_template_stays(docs):
    assert found(docs, (1, "Licensed under CC BY-NC 4.0."), (2, "Licensed under CC BY 4.0.")) == {1: [("CC-BY-NC-4.0", 1.0)], 2: [("CC-BY-4.0", 1.0)]}


def best_fit(a, b):
    """(score, matched words, end) of the best fit of a within b by the full table, over places that the band holds."""
    slack = len(b) - len(a)
    prev = {j: (0, 0) for j in range(slack + 1)}
    for i, x in enumerate(a, 1):
        now = {}
        for j in range(i, i + slack + 1):
            same = x == b[j - 1]
            ways = [(prev[j - 1][0] + (2 if same else -1), prev[j - 1][1] + same)]
            if j in prev:
                ways.append((prev[j][0] - 1, prev[j][1]))
            if j - 1 in now:
                ways.append((now[j - 1][0] - 1, now[j - 1][1]))
            now[j] = max(ways)
        prev = now
    top = max(prev.values())
    return *top, min(j for j, v in prev.items() if v == top)


def test_alignment_by_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randint(3, 25)
        a = [rng.randint(1, 9) for _ in range(n)]
        b = [rng.randint(1, 9) for _ in range(rng.randint(0, 6))] + [x if rng.random() > 0.05 else 30 for x in a if rng.random() > 0.06] + [rng.randint(1, 9) for _ in range(6)]
        b += [rng.randint(10, 19) for _ in range(max(0, n + 6 - len(b)))]
        matched, start, end = align(np.array(a, np.uint64), np.array(b, np.uint64))
        score, most, last = best_fit(a, b)
        assert (matched, end) == (most, last) and 0 <= start <= end <= len(b)
        # The span told has that alignment in it: fitted there alone, it scores no less.
        inner = b[start:end]
        table = [(0, 0)] * (len(inner) + 1)
        for x in a:
            row = [(table[0][0] - 1, table[0][1])]
            for j, y in enumerate(inner):
                row.append(max((table[j][0] + (2 if x == y else -1), table[j][1] + (x == y)), (table[j + 1][0] - 1, table[j + 1][1]), (row[j][0] - 1, row[j][1])))
            table = row
        assert max(table) >= (score, most)


def test_scan_against_every_place(docs):
    """Every edited copy of a template in a text is found, where aligning at every place finds it, and nowhere else."""
    rng = random.Random(10)
    template = [f"t{i}" for i in range(30)]
    rows, want = [], {}
    for i in range(60):
        copy = [w if rng.random() > 0.08 else f"x{rng.randint(0, 99)}" for w in template]
        text = [f"p{rng.randint(0, 99)}" for _ in range(rng.randint(0, 60))] + copy * rng.randint(0, 1) + [f"q{rng.randint(0, 99)}" for _ in range(rng.randint(0, 60))]
        rows.append((i, " ".join(text)))
        padded = ["-"] * 12 + text + ["-"] * 48
        want[i] = max(best_fit(template, padded[at : at + 42])[1] for at in range(len(padded) - 41)) / 30
    got = found(docs, *rows, templates={"t": " ".join(template)})
    for i, share in want.items():
        assert got[i] == ([("t", round(share, 3))] if share >= 0.8 else []), (i, share, got[i])


def test_repeats_long_texts_and_other_columns(docs):
    text = "filler word " * 300_000 + TEMPLATES["MIT"] + " more" * 1000
    table = docs((1, TEMPLATES["MIT"]), (1, TEMPLATES["MIT"]), (2, text), (3, "x" * 2_000_000)).withColumnRenamed("lang", "licenses").withColumnRenamed("source", "row")
    got = sorted(scan_licenses(table).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, [h.license for h in r.licenses]) for r in got] == [(1, ["MIT"]), (1, ["MIT"]), (2, ["MIT"]), (3, [])]
    hit = got[2].licenses[0]
    assert hit.first_word == 600_000 and text[hit.first_byte : hit.end_byte] == "Released under the MIT License"


def test_winnowing_guarantee():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    kept = winnow(h, 4)
    assert np.diff(kept).max() <= 4 and len(winnow(h[:3], 4)) == 3
    assert all(h[i : i + 4].min() in h[kept] for i in range(297))


@pytest.mark.parametrize("templates", [{}, {"none": "..."}])
def test_no_templates(docs, templates):
    assert found(docs, (1, "All rights reserved."), templates=templates) == {1: []}
    assert found(docs) == {}
