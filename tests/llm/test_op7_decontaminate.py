import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from labspark.llm._text import words
from labspark.llm.op7_decontaminate import BITS, RADIUS, LeakIndex, LeakParams, decontaminate, leaks, numbered, simhash

WORD = re.compile(r"(?:[0-9a-z]|[^\x00-\x7f])+")


def tokens(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def bag(w):
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def brute(text, items):
    """Items that some window of their length matches at 0.8, over all windows."""
    w, found = tokens(text), set()
    for item, t in items:
        own = tokens(t)
        for at in range(max(1, len(w) - len(own) + 1)):
            a, b = bag(w[at : at + len(own)]), bag(own)
            if own and w and 5 * sum((a & b).values()) >= 4 * sum((a | b).values()):
                found.add(item)
    return found


def test_by_brute_force(spark, docs):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([6, 12, 30, 45, 45, 60])] + [(50, "two words"), (51, ""), (52, None)]
    rows = [(0, None), (1, ""), (2, "one"), (3, "here are two words, indeed"), (4, "two, but not those words")]
    for i in range(60):
        item = rng.choice(items[:6])[1].split()
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            edit, at = rng.random(), rng.randrange(len(item))
            item[at : at + (edit < 0.7)] = [] if edit < 0.2 else [word()]
        rows.append((100 + i, " ".join([word() for _ in range(rng.randint(0, 40))]) + " " + ", ".join(item).upper() + "! " + " ".join(word() for _ in range(30))))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for params in (LeakParams(), LeakParams(part_words=20)):
        got = {r.doc_id: {h.item_id for h in r.leaks} for r in leaks(docs(*rows), benchmark, params).collect()}
        assert got == {i: brute(t, items) for i, t in rows}
    clean = decontaminate(docs(*rows), benchmark)
    assert {r.doc_id for r in clean.collect()} == {i for i, t in rows if not brute(t, items)}
    assert clean.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clash = decontaminate(docs(*rows).withColumnRenamed("lang", "leaks"), benchmark)
    assert clash.columns[2] == "leaks" and clash.count() == clean.count()


def best(text, items):
    """The best (similarity, first word) of each item over all windows, by brute force."""
    w, found = tokens(text), {}
    for item, t in items:
        own = tokens(t)
        for at in range(max(1, len(w) - len(own) + 1)) if own and w else []:
            a, b = bag(w[at : at + len(own)]), bag(own)
            low, high = sum((a & b).values()), sum((a | b).values())
            if 5 * low >= 4 * high and (low / high, -at) > found.get(item, (0, 0)):
                found[item] = (low / high, -at)
    return {i: (s, -at) for i, (s, at) in found.items()}


def test_reordered_inserted_and_repeated_passages():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abc") for _ in range(3))
    for trial in range(60):
        # Items of one size share passages, and some repeat themselves.
        base = [word() for _ in range(rng.choice([30, 60, 61]))]
        items = [(0, " ".join(base)), (1, " ".join(base[:-3] + [word() for _ in range(3)])), (2, " ".join((base[:10] * 7)[: len(base)])), (3, " ".join(word() for _ in base))]
        half = len(base) // 2
        texts = [
            " ".join(base[half:] + base[:half]),
            " ".join(base[:half] + [word(), word()] + base[half:]),
            " ".join([word()] * 3 + base[:10] * 9 + [word()] * 20),
            " ".join(base[10:] + base[:10] + base + base[half:]),
            " ".join(base[: len(base) * 9 // 10]),
        ]
        index = LeakIndex([i for i, _ in items], [t for _, t in items], LeakParams())
        for text, own in zip(texts, words(pa.array(texts), punctuation=False), strict=True):
            got = {i: (s, at) for i, (s, at, _) in index.hits(own.hashes).items()}
            assert got == best(text, items), trial


def test_swapped_halves_of_sixty_words():
    item = [f"w{i}" for i in range(60)]
    index = LeakIndex([1], [" ".join(item)], LeakParams())
    (own,) = words(pa.array([" ".join(item[30:] + item[:30])]), punctuation=False)
    assert index.hits(own.hashes) == {1: (52 / 60, 0, 60)}


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    index = LeakIndex(list(range(600)), [" ".join(map(str, rng.integers(0, 10**6, 20 + i % 2))) for i in range(600)], LeakParams())
    for _ in range(300):
        of = int(rng.integers(0, 600))
        base = np.unpackbits(index.prints[of].view(np.uint8))
        base[rng.choice(BITS, rng.integers(0, 110), replace=False)] ^= 1
        probe = np.packbits(base).view(np.uint64)
        want = [i for i in range(of % 2, 600, 2) if np.bitwise_count(index.prints[i] ^ probe).sum() <= RADIUS]
        assert index.candidates(probe, 20 + of % 2).tolist() == want


def test_fingerprints_at_the_threshold_are_within_the_radius():
    rng, far = np.random.default_rng(3), []
    for n in (9, 10, 18, 90, 400):
        for _ in range(400):
            a = rng.integers(0, 1 << 62, n).astype(np.uint64)
            b = a.copy()
            b[: n // 9] = rng.integers(0, 1 << 62, n // 9).astype(np.uint64)
            far.append(int(np.bitwise_count(simhash(numbered(a)) ^ simhash(numbered(b))).sum()))
    assert max(far) <= RADIUS and 30 < np.mean(far) < 40


def test_index_prunes_and_its_memory_follows_the_words():
    rng = np.random.default_rng(5)
    index = LeakIndex(list(range(4000)), [" ".join(map(str, rng.integers(0, 10**7, 40))) for _ in range(4000)], LeakParams())
    probe = rng.integers(0, 1 << 62, 4).astype(np.uint64)
    near = np.zeros(4000, bool)
    for column, own in zip(index.blocks[40], probe.view(np.uint32), strict=True):
        near |= np.bitwise_count(column ^ own) <= 8
    assert near.mean() < 0.05 and len(index.candidates(probe, 40)) == 0
    assert index.nbytes < 50 * 4000 * 40


def test_numbered_bags_have_the_weighted_similarity():
    a, b = np.array([1, 1, 2], np.uint64), np.array([3, 1], np.uint64)
    assert len(np.intersect1d(numbered(a), numbered(b))) == 1 and len(np.union1d(numbered(a), numbered(b))) == 4


def test_columns_of_any_name_and_very_long_texts(spark, docs):
    item = " ".join(f"word{i}" for i in range(40))
    long = "filler text of no note " * 60_000 + item + " filler" * 1000 + " " + "x" * 300_000
    rows = docs((1, item), (1, item), (2, long), (3, None), (4, "   "), (5, "clean text")).withColumnRenamed("lang", "old_leaks").withColumnRenamed("source", "row").withColumnRenamed("n_chars", "new_leaks")
    benchmark = spark.createDataFrame([(7, item), (7, item), (8, item), (None, item)], "item_id int, text string")
    found = leaks(rows, benchmark)
    assert found.columns == [*rows.columns, "leaks"]
    got = sorted((r.doc_id, [(h.item_id, h.similarity, h.n_words) for h in r.leaks]) for r in found.collect())
    assert got == [(1, [(7, 1.0, 40), (8, 1.0, 40)])] * 2 + [(2, [(7, 1.0, 40), (8, 1.0, 40)]), (3, []), (4, []), (5, [])]
    kept = decontaminate(rows, benchmark)
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]


def test_empty(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert leaks(docs((1, "x")), none).collect()[0].leaks == []
    assert leaks(docs(), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).collect() == []
