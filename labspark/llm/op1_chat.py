"""Chat formatting: a template compiler and a streaming renderer.

A small, sandboxed template language is parsed into a syntax tree, constant parts are
folded, and the tree is turned into Python closures. Templates see nothing but the
message, its place in the conversation and the constants given; there are no attribute
look-ups, calls or loops but those below, so a template can't reach Python.

    {{ expr }}                          output
    {% for m in messages %} ... {% endfor %}
    {% if expr %} ... {% elif expr %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}   marks what a model is trained to produce

An expr has 'strings', names, m.role, m.content, loop.first, loop.last, loop.index, ==, !=,
and, or, not, + (joining) and the filters | escape, | trim, | upper, | lower.

escape keeps control strings inside texts from being read as markers: a backslash goes in
after their first character, as one more where backslashes stand there already, so that
taking one away restores the text exactly; other text is left as it is.

Conversations are rendered message by message, as a sorted stream; none is held whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labspark.llm._text import batches

#: The strings that the templates of this module give a meaning of their own.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")

#: Every message is one marked turn with its role; assistant texts are the generation.
INST_TEMPLATE = """{% for m in messages %}{{ '[INST]' + (m.role | escape) + '[/INST]' }}{% if m.role == 'assistant' %}{% generation %}{{ m.content | escape }}{% endgeneration %}{% else %}{{ m.content | escape }}{% endif %}{{ '</s>' }}{% endfor %}"""


class TemplateError(ValueError):
    """A template that the language does not allow."""


# Syntax tree: every node is a tuple whose first entry names its kind.
_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(==|!=|[()+|.])|([A-Za-z_]\w*)|(\S))")
_STRING_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expr:
    """Recursive descent over one expression."""

    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        for m in _TOKEN.finditer(text.strip()):
            if m[4]:
                raise TemplateError(f"unexpected {m[4]!r} in {text!r}")
            self.tokens.append(("string", m[1]) if m[1] else ("mark", m[2]) if m[2] else ("name", m[3]))
        self.at, self.text = 0, text

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self, want: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or want is not None and self.tokens[self.at][1] != want:
            raise TemplateError(f"expected {want or 'more'} in {self.text!r}")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> tuple:
        node = self.either()
        if self.peek() is not None:
            raise TemplateError(f"unexpected {self.peek()!r} in {self.text!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.peek() == "or":
            self.take()
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.peek() == "and":
            self.take()
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        if self.peek() == "not":
            self.take()
            return ("not", self.negated())
        node = self.joined()
        while self.peek() in ("==", "!="):
            kind = self.take()[1]
            node = (kind, node, self.joined())
        return node

    def joined(self) -> tuple:
        node = self.filtered()
        while self.peek() == "+":
            self.take()
            node = ("+", node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.single()
        while self.peek() == "|":
            self.take()
            name = self.take()[1]
            if name not in ("escape", "trim", "upper", "lower"):
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", name, node)
        return node

    def single(self) -> tuple:
        kind, value = self.take()
        if value == "(":
            node = self.either()
            self.take(")")
            return node
        if kind == "string":
            return ("const", re.sub(r"\\(.)", lambda m: _STRING_ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind != "name" or value in ("and", "or", "not"):
            raise TemplateError(f"unexpected {value!r} in {self.text!r}")
        if value in ("true", "false"):
            return ("const", value == "true")
        if self.peek() == ".":
            self.take()
            return ("field", value, self.take()[1])
        return ("name", value)


def parse(template: str) -> list[tuple]:
    """The syntax tree of a template."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _TAG.finditer(template):
        parts.append(("text", template[at : m.start()]))
        parts.append(("out", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    parts.append(("text", template[at:]))
    body, rest, end = _body(parts, 0, ())
    if rest != len(parts):
        raise TemplateError(f"unexpected {end!r}")
    return body


def _body(parts: list[tuple[str, str]], at: int, ends: tuple[str, ...]) -> tuple[list[tuple], int, str]:
    out: list[tuple] = []
    while at < len(parts):
        kind, value = parts[at]
        at += 1
        if kind == "text":
            if value:
                out.append(("out", ("const", value)))
        elif kind == "out":
            out.append(("out", _Expr(value).whole()))
        elif (word := value.split(None, 1)[0] if value else "") in ends:
            return out, at, value
        elif word == "for":
            if not (m := re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+messages", value)):
                raise TemplateError(f"only loops over messages: {value!r}")
            inner, at, _ = _body(parts, at, ("endfor",))
            out.append(("for", m[1], inner))
        elif word == "generation":
            inner, at, _ = _body(parts, at, ("endgeneration",))
            out.append(("generation", inner))
        elif word == "if":
            arms, test, ended = [], _Expr(value[2:]).whole(), ""
            while ended != "endif":
                inner, at, ended = _body(parts, at, ("elif", "else", "endif"))
                arms.append((test, inner))
                if ended.startswith("elif"):
                    test = _Expr(ended[4:]).whole()
                elif ended == "else":
                    test = ("const", True)
            out.append(("if", arms))
        else:
            raise TemplateError(f"no tag {value!r} here")
    if ends:
        raise TemplateError(f"missing {ends[-1]}")
    return out, at, ""


def fold(node, constants: dict[str, str]):
    """The tree with constant expressions evaluated, dead branches dropped and outputs joined."""
    if isinstance(node, list):
        out: list[tuple] = []
        for part in node:
            for new in fold(part, constants):
                if new[0] == "out" and new[1][0] == "const" and out and out[-1][0] == "out" and out[-1][1][0] == "const":
                    out[-1] = ("out", ("const", _text(out[-1][1][1]) + _text(new[1][1])))
                else:
                    out.append(new)
        return out
    kind = node[0]
    if kind == "out":
        return [("out", _fold_expr(node[1], constants))]
    if kind == "for":
        return [("for", node[1], fold(node[2], constants))]
    if kind == "generation":
        return [("generation", fold(node[1], constants))]
    arms = []
    for test, inner in node[1]:
        test = _fold_expr(test, constants)
        if test[0] == "const" and not test[1]:
            continue
        arms.append((test, fold(inner, constants)))
        if test[0] == "const":
            break
    if arms and arms[0][0][0] == "const":
        return arms[0][1]
    return [("if", arms)] if arms else []


def _fold_expr(node: tuple, constants: dict[str, str]) -> tuple:
    if node[0] == "name":
        if node[1] not in constants:
            raise TemplateError(f"no name {node[1]!r}")
        return ("const", constants[node[1]])
    if node[0] in ("const", "field"):
        return node
    new = tuple(_fold_expr(x, constants) if isinstance(x, tuple) else x for x in node)
    if all(x[0] == "const" for x in new[1:] if isinstance(x, tuple)):
        return ("const", _expr(new)({}))
    return new


def _text(value) -> str:
    return value if isinstance(value, str) else "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def escaping(controls: tuple[str, ...] = CONTROLS) -> tuple[Callable[[str], str], Callable[[str], str]]:
    """(escape, unescape) for control strings of two characters or more; unescape undoes escape exactly."""
    put = re.compile("|".join(rf"{re.escape(c[0])}(?=\\*{re.escape(c[1:])})" for c in controls))
    drop = re.compile("|".join(rf"{re.escape(c[0])}\\(?=\\*{re.escape(c[1:])})" for c in controls))
    return (lambda text: put.sub(lambda m: m[0] + "\\", text)), (lambda text: drop.sub(lambda m: m[0][0], text))


ESCAPE, UNESCAPE = escaping()
_FILTERS: dict[str, Callable[[str], str]] = {"escape": ESCAPE, "trim": str.strip, "upper": str.upper, "lower": str.lower}


def _expr(node: tuple) -> Callable[[dict], object]:
    """A closure from the scope to the value of an expression."""
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda scope: value
    if kind == "field":
        name = (node[1], node[2])
        return lambda scope: scope[name]
    if kind == "filter":
        apply, inner = _FILTERS[node[1]], _expr(node[2])
        return lambda scope: apply(_text(inner(scope)))
    parts = [_expr(x) for x in node[1:]]
    if kind == "not":
        return lambda scope: not parts[0](scope)
    a, b = parts
    if kind == "+":
        return lambda scope: _text(a(scope)) + _text(b(scope))
    if kind == "==":
        return lambda scope: a(scope) == b(scope)
    if kind == "!=":
        return lambda scope: a(scope) != b(scope)
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    return lambda scope: a(scope) or b(scope)


Piece = tuple[str, bool]
_Render = Callable[[dict, bool], Iterator[Piece]]


def _closure(body: list[tuple]) -> _Render:
    steps = [_step(node) for node in body]

    def run(scope: dict, marked: bool) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope, marked)

    return run


def _step(node: tuple) -> _Render:
    kind = node[0]
    if kind == "out":
        value = _expr(node[1])

        def out(scope: dict, marked: bool) -> Iterator[Piece]:
            if text := _text(value(scope)):
                yield text, marked

        return out
    if kind == "generation":
        inner = _closure(node[1])
        return lambda scope, marked: inner(scope, True)
    if kind == "if":
        arms = [(_expr(test), _closure(inner)) for test, inner in node[1]]

        def choose(scope: dict, marked: bool) -> Iterator[Piece]:
            for test, inner in arms:
                if test(scope):
                    return inner(scope, marked)
            return iter(())

        return choose
    raise TemplateError("loops can't be nested")


@dataclass(frozen=True)
class Template:
    """A compiled template: what comes before the loop, at each message, and after it."""

    head: _Render
    turn: _Render
    tail: _Render
    name: str

    def message(self, role: str, content: str, index: int, last: bool) -> Iterator[Piece]:
        """(text, whether it is generation) in order for one message."""
        scope = {(self.name, "role"): role, (self.name, "content"): content, ("loop", "index"): str(index + 1), ("loop", "first"): index == 0, ("loop", "last"): last}
        if index == 0:
            yield from self.head({}, False)
        yield from self.turn(scope, False)
        if last:
            yield from self.tail({}, False)

    def render(self, messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The whole text and its generation spans in code points; neighbouring spans stay apart."""
        out, spans, at = [], [], 0
        for i, (role, content) in enumerate(messages):
            for text, marked in self.message(role, content, i, i == len(messages) - 1):
                if marked:
                    spans.append((at, at + len(text)))
                out.append(text)
                at += len(text)
        return "".join(out), spans


def _fields(node, known: set[tuple[str, str]]) -> None:
    if isinstance(node, list | tuple):
        if len(node) == 3 and node[0] == "field" and (node[1], node[2]) not in known:
            raise TemplateError(f"no field {node[1]}.{node[2]} here")
        for part in node:
            _fields(part, known)


def compile_template(template: str = INST_TEMPLATE, **constants: str) -> Template:
    """Closures for a template with one loop over messages; names are looked up in constants."""
    tree = fold(parse(template), constants)
    loops = [i for i, node in enumerate(tree) if node[0] == "for"]
    if len(loops) != 1:
        raise TemplateError("a template has one loop over messages")
    at = loops[0]
    name = tree[at][1]
    _fields(tree[:at] + tree[at + 1 :], set())
    _fields(tree[at][2], {(name, "role"), (name, "content"), ("loop", "index"), ("loop", "first"), ("loop", "last")})
    return Template(_closure(tree[:at]), _closure(tree[at][2]), _closure(tree[at + 1 :]), name)


FORMATTED = "conv_id long, n_turns long, piece int, formatted string, spans array<struct<start: long, stop: long>>"


def format_conversations(conversations: DataFrame, template: str = INST_TEMPLATE, piece_chars: int = 1 << 20, **constants: str) -> DataFrame:
    """Each conversation's formatted text, with its generation spans.

    Rows go by turn (null first), equal turns by role and text, so that the order is defined;
    repeated rows are turns of their own. A null text or role is empty. Null conv_ids make one
    conversation. A conversation longer than piece_chars comes in several rows, numbered by
    piece, whose texts follow each other; spans count code points from the conversation's
    start, and n_turns is null but in the last piece.
    """
    rows = conversations.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = compile_template(template, **constants)
        writer = _Writer(compiled, piece_chars)
        for batch in batches(batches_):
            yield writer.batch(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True))
        writer.finish()
        yield writer.taken()

    return ordered.mapInArrow(run, FORMATTED)


class _Writer:
    """Renders a sorted stream of messages; holds one message and one piece of text."""

    def __init__(self, template: Template, piece_chars: int) -> None:
        self.template, self.piece_chars = template, piece_chars
        self.rows: list[tuple] = []
        self.held: tuple | None = None
        self.index = self.piece = self.at = self.size = 0
        self.texts: list[str] = []
        self.spans: list[dict] = []

    def batch(self, messages: Iterator[tuple]) -> pa.RecordBatch:
        for message in messages:
            if self.held is not None:
                self._one(self.held, last=message[0] != self.held[0])
            self.held = message
        return self.taken()

    def finish(self) -> None:
        if self.held is not None:
            self._one(self.held, last=True)
        self.held = None

    def _one(self, message: tuple, last: bool) -> None:
        for text, marked in self.template.message(message[1], message[2], self.index, last):
            if marked:
                self.spans.append({"start": self.at, "stop": self.at + len(text)})
            self.texts.append(text)
            self.at += len(text)
            self.size += len(text)
        self.index += 1
        if last or self.size >= self.piece_chars:
            self.rows.append((message[0], self.index if last else None, self.piece, "".join(self.texts), self.spans))
            self.texts, self.spans, self.size = [], [], 0
            self.piece += 1
        if last:
            self.index = self.piece = self.at = 0

    def taken(self) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
        columns = [pa.array([r[i] for r in self.rows], kind) for i, kind in enumerate(kinds)]
        self.rows = []
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "n_turns", "piece", "formatted", "spans"])


_TURN = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>", re.S)


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn in a text that INST_TEMPLATE made: markers delimit, escapes are undone."""
    for m in _TURN.finditer(formatted):
        yield UNESCAPE(m[1]), UNESCAPE(m[2])


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """Digests of what format_conversations made with INST_TEMPLATE, read back from its output alone.

    turns_sha256 is over role, line break, text and line break of each turn; loss_sha256 over
    the unescaped text under the generation spans, one after the other, and loss_chars its
    code points. The pieces of a conversation follow each other in one partition.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, loss, counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
        for batch in rows:
            out: list[tuple] = []
            for conv, n, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n_turns", "formatted", "spans")), strict=True):
                for role, content in read_back(text):
                    turns.update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
                    counts[0] += 1
                for span in spans:
                    own = UNESCAPE(text[span["start"] - counts[2] : span["stop"] - counts[2]])
                    loss.update(own.encode("utf-8", "surrogatepass"))
                    counts[1] += len(own)
                counts[2] += len(text)
                if n is not None:
                    out.append((conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]))
                    turns, loss, counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, DIGESTS)
