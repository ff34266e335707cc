import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labspark.llm.op9_token_counts import PrefixCounter, chars_within, prefix_tokens, tokens_at

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["it's we're I've they'll x'd 're 'r 've'l", "<|endoftext|>a<|startoftext|>b <|endo", "İstanbul ΣΑΣ naïve é x y 中文字 123 ½ ²", "a" * 500 + " " + "ab" * 400, "!!! ...'s '' \"'t", "", "\x1c\x1d a\x85b İ", "ﬁ ﬀ ŀ ŉ ß ẞ Ǆ 😀 ​", "é cafés"]


@pytest.fixture(scope="module")
def counter():
    return PrefixCounter(PATH)


def library(counter, text):
    return len(counter.library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(counter, text):
    table = counter.changes(text)
    assert counter.total(text) == tokens_at(table, len(table)) == library(counter, text)


@given(st.text(st.one_of(st.sampled_from("thersino'ds 1!.\n"), st.characters(codec="utf-8")), max_size=80))
@settings(max_examples=300, deadline=None)
def test_any_text(counter, text):
    assert counter.total(text) == library(counter, text)


def test_every_prefix(counter):
    rng = random.Random(1)
    for _ in range(30):
        text = "".join(rng.choice(["the", "re", "ing", "tion", " ", "'", "s", "é", "1", ".", "\n", "er", "x"]) for _ in range(60))
        table = counter.changes(text)
        counts = [library(counter, text[:k]) for k in range(len(text) + 1)]
        assert [tokens_at(table, k) for k in range(len(text) + 1)] == counts
        for budget in (0, 3, 17, 1000):
            assert chars_within(table, budget) == counter.fits(text, budget) == max(k for k in range(len(text) + 1) if counts[k] <= budget)


def test_query(docs, counter):
    rows = [(1, None), (2, ""), (3, "é" * 10), (4, "the words of this text " * 600), (4, "the words of this text " * 600), (None, "no id")]
    got = prefix_tokens(docs(*rows), PATH, keep_prefixes=True).collect()
    assert [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got] == [(i, len((t or "").encode()), library(counter, t or ""), library(counter, t or "") > 2048) for i, t in rows]
    assert library(counter, rows[3][1][: got[3].fits]) <= 2048 < library(counter, rows[3][1][: got[3].fits + 4])
    assert all(tokens_at(bytes(r.prefixes), len(r.prefixes)) == r.n_tokens for r in got)
    assert prefix_tokens(docs(), PATH).collect() == []
