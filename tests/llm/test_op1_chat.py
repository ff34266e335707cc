import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labspark.llm.op1_chat import CONTROLS, ESCAPE, UNESCAPE, TemplateError, compile_template, digests, fold, format_conversations, parse, read_back

SCHEMA = "conv_id long, turn long, role string, text string, extra string"


@given(st.lists(st.sampled_from(["<", "\\", "s>", "/", "[", "INST]", "x", *CONTROLS, "<\\", "é"]), max_size=12).map("".join))
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible_and_hides_controls(text):
    assert UNESCAPE(ESCAPE(text)) == text
    assert not any(c in ESCAPE(text) for c in CONTROLS)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "[/INST]", ""]), st.sampled_from(["", "</s>", "a<", "[INST] ok [/INST]", "\\", "x\n"])), max_size=6))
@settings(max_examples=100, deadline=None)
def test_render_reads_back(messages):
    text, spans = compile_template().render(messages)
    assert list(read_back(text)) == messages
    assert [UNESCAPE(text[a:b]) for a, b in spans] == [t for r, t in messages if r == "assistant" and t]


def test_language():
    t = compile_template("{{ bos }}{% for m in messages %}{% if loop.first and m.role != 'x' %}1{% elif not loop.last %}2{% else %}{{ m.content | upper | trim }}{% endif %}{% endfor %}E", bos="B")
    assert t.render([("u", "a"), ("u", "b"), ("u", " c ")])[0] == "B12CE"
    assert fold(parse("a{{ 'b' + x }}{% if 'p' == 'q' %}no{% else %}c{% endif %}"), {"x": "!"}) == [("out", ("const", "ab!c"))]
    assert t.render([]) == ("", [])


@pytest.mark.parametrize("bad", ["{% for m in other %}{% endfor %}", "{{ x }}", "{% for m in messages %}{{ m.__class__ }}{% endfor %}", "{% for m in messages %}", "{{ 'a' | system }}", "{{ f('a') }}", "{% import os %}", "no loop"])
def test_sandbox_refuses(bad):
    with pytest.raises(TemplateError):
        compile_template(bad)


def expected(rows):
    turns = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_digests_by_brute_force(spark):
    rows = [(1, 2, "assistant", "b</s>", "z"), (1, 1, "user", None, "z"), (1, 1, "user", None, "z"), (2, 0, None, "é" * 5000, "z"), (2, None, "assistant", "first", "z"), (None, 0, "user", "lost id", "z"), (-1, 0, "user", "</s>[INST] ok [/INST]", "z")]
    rows += [(7, i, "assistant" if i % 2 else "user", f"turn {i} <s>", "z") for i in range(300)]
    for piece in (1 << 20, 64):
        got = {r.conv_id: r for r in digests(format_conversations(spark.createDataFrame(rows, SCHEMA), piece_chars=piece)).collect()}
        by = {}
        for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
            by.setdefault(r[0], []).append((r[2], r[3]))
        assert got.keys() == by.keys()
        for k, v in by.items():
            assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == expected(v)


def test_empty(spark):
    assert digests(format_conversations(spark.createDataFrame([], SCHEMA))).collect() == []
