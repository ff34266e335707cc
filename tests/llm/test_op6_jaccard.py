import random
import re

import numpy as np
import pytest

from labspark.llm.op6_jaccard import JaccardParams, _bands, _bits, _hamming, _keys, _plan, _told_apart, exact_sets, jaccard_components, keep_one

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, width):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    k = min(width, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows, p):
    sets = [shingle_set(r[1], p.width) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and p.den * both >= p.num * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    best = {}
    for i, r in enumerate(rows):
        best[root(i)] = min(best.get(root(i), r[0]), r[0])
    return sorted((r[0], len(sets[i]), best[root(i)]) for i, r in enumerate(rows))


def corpus(seed):
    """Copies, near copies around originals of many sizes, boilerplate, ties and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared = [word() for _ in range(40)]
    texts = ["", None, " \n", "one", "One", "a b", "a b c", "a  B c", "a b c d", "a b c d e"]
    for n in [5, 8, 13, 30, 90, 400]:
        base = [word() for _ in range(n)]
        for _ in range(14):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, max(1, n // 40), n // 15])):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    for _ in range(40):
        texts.append(" ".join([word() for _ in range(20)] + shared + [word() for _ in range(rng.choice([2, 30]))]))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize(("width", "num", "small", "rows"), [(4, 85, 8, 128), (5, 80, 2, 8)])
def test_by_brute_force(docs, width, num, small, rows):
    data = corpus(width)
    p = JaccardParams(width=width, num=num, small_group=small, sketch_rows=rows, chunk_rows=rows)
    got = jaccard_components(docs(*data), p).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(data, p)


def test_pigeonhole_and_sketch_bounds():
    """Any two sets at the threshold share a key, and no sketch distance exceeds the difference."""
    rng, p = np.random.default_rng(1), JaccardParams(num=85)
    lows = _bands(p)
    for _ in range(400):
        n = int(rng.choice([1, 2, 6, 7, 8, 12, 13, 20, 60, 300]))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = int(rng.integers(0, n * 15 // 100 + 1))
        add = int(rng.integers(0, max(1, (n - drop) * 100 // 85 - n + 1)))
        b = np.unique(np.concatenate((a[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64))))
        both = len(np.intersect1d(a, b))
        difference = len(a) + len(b) - 2 * both
        assert _hamming(_bits(a), _bits(b)) <= difference
        if 100 * both >= 85 * (len(a) + len(b) - both):
            assert np.intersect1d(_keys(a, lows, p), _keys(b, lows, p)).size
            assert difference <= _plan(int(np.searchsorted(lows, min(len(a), len(b)), side="right")) - 1, lows, p)[0]


def test_odd_rows(docs):
    same = "some words that are the same in both of these rows"
    got = jaccard_components(docs((3, same), (3, same), (2, same), (None, same), (9, None), (9, None))).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted([(3, 2), (3, 2), (2, 2), (None, 2), (9, 9), (9, 9)], key=str)
    assert jaccard_components(docs()).collect() == []


def test_keep_one(docs):
    same = "some words that are the same in both of these rows"
    got = keep_one(docs((3, same), (2, same), (2, same), (4, "quite another text"), (5, None), (None, "lost")))
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted([2, 4, 5, None], key=str)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_exact_sets_are_the_sets_of_words():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "B", "b", "\u00e9", "cc", str(rng.randrange(5000))]) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 300]))) for _ in range(60)] + ["", "  ", "a b", "b a", "a b\x1cc"]
    for width in (1, 2, 4, 5, 9):
        got, want = exact_sets([t.encode() for t in texts], width), [shingle_set(t, width) for t in texts]
        for a, x in zip(got, want, strict=True):
            assert len(a) == len(x)
            for b, y in zip(got, want, strict=True):
                assert len(np.intersect1d(a, b)) == len(x & y)


def test_large_clusters_of_differing_texts(docs):
    """Copies near their original but not near each other, chains, and parts that only sketches bring together."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(3):
        base = [word() for _ in range(120)]
        texts.append(base)
        for _ in range(60):
            own = list(base)
            at = rng.randrange(105)
            own[at : at + 5] = [word() for _ in range(rng.choice([4, 5, 6, 9, 12, 15]))]
            texts.append(own)
        for _ in range(20):
            base = list(base)
            base[rng.randrange(120)] = word()
            texts.append(base)
    rows = list(enumerate(" ".join(t) for t in texts))
    rng.shuffle(rows)
    p = JaccardParams(width=4, num=85, small_group=4, sketch_rows=16, chunk_rows=6)
    got = jaccard_components(docs(*rows), p).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, p)


def test_patterned_and_very_long_words(docs):
    """Words that collide under polynomial hashes, and texts of a million letters."""
    morse = "".join("ab"[i.bit_count() & 1] for i in range(4096))
    other = morse.translate(str.maketrans("ab", "ba"))
    long = "x" * 1_500_000
    rows = [(1, " ".join([morse] * 6)), (2, " ".join([other] * 6)), (3, f"{long} one two"), (4, f"{long}y one two"), (5, f"{long.upper()} one  two"), (6, "word " * 400_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs(*rows)).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (1, 4), 5: (1, 3), 6: (1, 6)}


def test_rows_that_share_an_id_but_not_the_text(docs):
    one = [f"a{i}" for i in range(60)]
    two = [f"b{i}" for i in range(60)]
    rows = [(1, " ".join(one)), (1, " ".join(two)), (1, None), (2, " ".join(one + ["x"])), (3, " ".join(two + ["y"])), (4, " ".join([*two, "z"]))]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs(*rows)).collect())
    assert got == [(1, 0, 1), (1, 56, 1), (1, 56, 1), (2, 57, 1), (3, 57, 1), (4, 57, 1)]


def test_sets_that_share_a_key_half_are_told_apart(spark):
    rows = [(1, 3, 7, 100, b"a", [1]), (2, 3, 7, 100, None, []), (3, 4, 7, 200, b"b", [2]), (4, 4, 8, 300, b"c", [3]), (5, 0, None, None, None, [])]
    sets, nodes = _told_apart(spark.createDataFrame(rows, "doc_id long, n_shingles long, node long, check long, sketch binary, keys array<long>"))
    got = {r.doc_id: r.node for r in sets.collect()}
    assert got[1] == got[2] != got[3] and got[3] not in (got[4], None) and got[4] == 8 and got[5] is None
    assert {(r.node, r.rep, r.n) for r in nodes.collect()} == {(got[1], 1, 3), (got[3], 3, 4), (8, 4, 4)}


def test_keep_one_with_columns_of_any_name(docs):
    same = "some words that are the same in both of these rows"
    table = docs((3, same), (2, same), (4, "other")).withColumnRenamed("lang", "row").withColumnRenamed("source", "bucket").withColumnRenamed("n_chars", "component_id")
    got = keep_one(table)
    assert got.columns == table.columns and sorted((r.doc_id, r.component_id) for r in got.collect()) == [(2, len(same)), (4, 5)]
