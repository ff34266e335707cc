import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from labspark.llm import _text

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def check(texts, column):
    by_word = {}
    for text, own in zip(texts, _text.words(column), strict=True):
        raw = (text or "").encode()
        lowered = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
        found = list(WORD.finditer(lowered))
        assert [(m.start(), m.end()) for m in found] == list(zip(own.starts.tolist(), own.ends.tolist(), strict=True))
        for m, h in zip(found, own.hashes.tolist(), strict=True):
            assert by_word.setdefault(m[0], h) == h
    assert len(set(by_word.values())) == len(by_word)


@given(st.lists(st.none() | st.text(st.sampled_from("aAbB é中\n\t\r\x0b\x1c\x85  .!"), max_size=40), max_size=8))
@settings(max_examples=200, deadline=None)
def test_words_by_regex(texts):
    check(texts, pa.array(texts, pa.string()))


def test_slices_offsets_and_very_long_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choice(["ab", "C", " ", "\n", "é"]) for _ in range(n)) for n in (0, 5, 400_000, 3, 1_900_000, 700)] + ["x" * 2_600_000 + " y", None]
    whole = pa.array(["before", *texts, "after"], pa.string())
    check(texts, whole.slice(1, len(texts)))


def test_punctuation_as_space():
    (own,) = _text.words(pa.array(["Licensed under CC BY-NC 4.0. é!"]), punctuation=False)
    (same,) = _text.words(pa.array(["licensed under cc by nc 4 0 é"]))
    assert own.hashes.tolist() == same.hashes.tolist()


def test_shingles():
    h = np.arange(10, dtype=np.uint64)
    assert len(_text.shingles(h, 4)) == 7 and len(_text.shingles(h[:3], 4)) == 1 and len(_text.shingles(h[:0], 4)) == 0
    assert _text.shingles(h, 4)[2] == _text.shingles(h[2:6], 4)[0] != _text.shingles(h[2:5], 4)[0]


def test_batches_bound_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 100)], names=["text"])
    parts = list(_text.batches(iter([batch]), 10_000))
    assert sum(p.num_rows for p in parts) == 100 and max(p.num_rows for p in parts) <= 10


def test_no_collisions_of_patterned_words():
    """Thue-Morse words and their complements collide under polynomials modulo a power of two."""
    found = {}
    for n in (8, 64, 1024, 8192):
        word = "".join("ab"[i.bit_count() & 1] for i in range(n))
        for text in (word, word.translate(str.maketrans("ab", "ba")), word[::-1] + "a", "a" * n, "a" * (n - 1) + "b", "b" + "a" * (n - 1)):
            (own,) = _text.words(pa.array([text]))
            assert found.setdefault(text, own.hashes.tolist()) == own.hashes.tolist() and len(own.hashes) == 1
    assert len({h[0] for h in found.values()}) == len(found)
