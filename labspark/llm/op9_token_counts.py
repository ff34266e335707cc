"""Token counts at every prefix, by dynamic programming over byte-pair merges.

The tokenizer splits a normalised text into words and merges each by rank. A token sequence
of a word is its encoding exactly if every token is stable by itself and every neighbouring
pair is (no merge crosses the boundary before both tokens are complete). So the encoding of
a prefix is that of a shorter prefix and one last token, and a table over prefixes holds
the exact count at each, as text cut there would be encoded: its last word then carries
the end-of-word mark. The tables of words and of word prefixes are shared across texts.

The table of a text is a signed byte for each character: the change of the count. Its
running sum answers how many tokens a truncation has and how far a budget reaches, without
encoding again. Documents are handled one by one in a map, without a shuffle.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labspark.llm._text import batches, buffers

_NEVER = 1 << 60
#: Entries of a cache before it starts anew, and symbols of a word beyond which nothing is cached.
_CACHE, _LONG = 300_000, 48


class PrefixCounter:
    """Exact prefix token counts for a word-level BPE tokenizer file with an end-of-word suffix."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.parts = {a + b: (a, b) for a, b in merges}
        self.vocab = set(model["vocab"])
        # Longest token by its last two symbols, with and without the end-of-word mark.
        self.reach: dict[str, dict[str, int]] = {"": {}, self.end: {}}
        for token in self.vocab:
            for end, known in self.reach.items():
                if token.endswith(end):
                    own = token[: len(token) - len(end)]
                    known[own[-2:]] = max(known.get(own[-2:], 0), len(own))
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        # Characters up to U+017F are split here, by the classes of the tokenizer's pattern; others by the library.
        low = [chr(c) for c in range(0x180)]
        kind = lambda k: "".join(re.escape(c) for c in low if unicodedata.category(c)[0] == k)
        space = r"\t-\r \x85\xa0"
        letter, number = kind("L"), kind("N")
        one = rf"(?:'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{space}{letter}{number}]+)"
        self.bare = re.compile(one)
        self.word = re.compile(rf"{one}[{space}]*|[{space}]+")
        self.blank = "".join(chr(c) for c in (*range(9, 14), 0x20, 0x85, 0xA0))
        self.plain = re.compile("[\x00-įı-ſ]*").fullmatch
        self.bytes = self._byte_symbols()
        self.rights: dict[str, list] = {}
        self.lefts: dict[str, list] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.stable_: dict[str, bool] = {}
        self.prefixes: dict[str, tuple[str, int]] = {}
        self.tables: dict[str, bytes] = {}
        self.totals: dict[str, int] = {}

    @staticmethod
    def _byte_symbols() -> list[str]:
        """The printable character that stands for each byte: itself, or one from U+0100 on."""
        own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        spare = iter(range(0x100, 0x200))
        return [chr(b) if b in own else chr(next(spare)) for b in range(256)]

    def _spine(self, token: str, side: int, known: dict[str, list]) -> list:
        """[(node, rank at which it is merged into its parent)] from the outermost symbol up to token."""
        got = known.get(token)
        if got is None:
            got, node, above = [], token, _NEVER
            while True:
                got.append((node, above))
                if node not in self.parts:
                    break
                above = self.rank[self.parts[node]]
                node = self.parts[node][side]
            got.reverse()
            known[token] = got
        return got

    def _pair(self, a: str, b: str) -> bool:
        """Whether the boundary of tokens a and b outlasts all merges; of equal ranks the left goes first."""
        got = self.pairs.get((a, b))
        if got is None:
            left, right = self._spine(a, 1, self.rights), self._spine(b, 0, self.lefts)
            i = j = 0
            while True:
                (x, up), (y, down) = left[i], right[j]
                rank = self.rank.get((x, y))
                if rank is not None and rank < up and rank <= down:
                    got = False
                    break
                if up == down == _NEVER:
                    got = True
                    break
                if up <= down:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) > 4 * _CACHE:
                self.pairs.clear()
            self.pairs[a, b] = got
        return got

    def _stable(self, token: str) -> bool:
        """Whether the symbols of token encode to token itself."""
        got = self.stable_.get(token)
        if got is None:
            got = token in self.vocab
            if token in self.parts:
                a, b = self.parts[token]
                # The two halves form, stay apart until their own merge, and nothing splits them.
                got = got and self._stable(a) and self._stable(b) and self._apart(a, b)
            self.stable_[token] = got
        return got

    def _apart(self, a: str, b: str) -> bool:
        """Whether a and b both form before a merge crosses their boundary."""
        left, right = self._spine(a, 1, self.rights), self._spine(b, 0, self.lefts)
        i = j = 0
        while i < len(left) - 1 or j < len(right) - 1:
            (x, up), (y, down) = left[i], right[j]
            rank = self.rank.get((x, y))
            if rank is not None and rank < up and rank <= down:
                return False
            if up <= down:
                i += 1
            else:
                j += 1
        return True

    def _last(self, symbols: str, i: int, end: str, states: list | None) -> tuple[str, int]:
        """(last token, count) of the first i symbols, the last one marked with end."""
        reach = self.reach[end]
        most = reach.get(symbols[i - 2 : i] if i > 1 else symbols[:1], 1)
        for n in range(min(i, most), 0, -1):
            token = symbols[i - n : i] + end
            if token in self.vocab and self._stable(token):
                if n == i:
                    return token, 1
                before = states[i - n] if states is not None else self.prefixes[symbols[: i - n]]
                good = self.pairs.get((before[0], token))
                if good or good is None and self._pair(before[0], token):
                    return token, before[1] + 1
        raise ValueError(f"no token ends {symbols[max(0, i - 20) : i]!r}")

    def _states(self, symbols: str) -> list | None:
        """(last token, count) of each proper prefix as the start of a longer word; None: in the shared table."""
        if len(symbols) <= _LONG:
            prefixes = self.prefixes
            if len(prefixes) > _CACHE:
                prefixes.clear()
            for i in range(1, len(symbols)):
                if symbols[:i] not in prefixes:
                    prefixes[symbols[:i]] = self._last(symbols, i, "", None)
            return None
        states: list = [None]
        for i in range(1, len(symbols)):
            states.append(self._last(symbols, i, "", states))
        return states

    def word_counts(self, symbols: str) -> list[int]:
        """Tokens of each prefix of a word's byte symbols, each as a word of its own."""
        states = self._states(symbols)
        return [self._last(symbols, i, self.end, states)[1] for i in range(1, len(symbols) + 1)]

    def total(self, text: str) -> int:
        """The count of the whole text: the last entries of its words' tables alone."""
        if not self._is_plain(text):
            table = self.changes(text)
            return tokens_at(table, len(table))
        known = self.totals
        n = 0
        for word in self.bare.findall(text.lower()):
            got = known.get(word)
            n += self._word_total(word) if got is None else got
        return n

    def _word_total(self, word: str) -> int:
        got = self.totals.get(word)
        if got is None:
            symbols = self._symbols(word)[0]
            got = self._last(symbols, len(symbols), self.end, self._states(symbols))[1]
            if len(word) <= _LONG:
                if len(self.totals) > 2 * _CACHE:
                    self.totals.clear()
                self.totals[word] = got
        return got

    def fits(self, text: str, budget: int) -> int:
        """The longest prefix, in characters, of at most budget tokens.

        Counts rise from word to word, so it ends before or in the last word that starts below
        the budget: totals lead there, and that word's table tells how far it reaches.
        """
        if not self._is_plain(text):
            return chars_within(self.changes(text), budget)
        n, text = 0, text.lower()
        for m in self.bare.finditer(text):
            if n >= budget:
                return m.start()
            total = self._word_total(m[0])
            if n + total > budget:
                reach = [i for i, c in enumerate(self._table(m[0]), 1) if n + c <= budget]
                return m.start() + (reach[-1] if reach else 0)
            n += total
        return len(text)

    def _is_plain(self, text: str) -> bool:
        return bool(self.plain(text)) and "<|" not in text and (text.isascii() or unicodedata.is_normalized("NFC", text))

    def _symbols(self, word: str) -> tuple[str, list[int]]:
        """Byte symbols of a word, and the number of symbols up to the end of each character."""
        if word.isascii():
            return "".join(self.bytes[ord(c)] for c in word), list(range(1, len(word) + 1))
        parts = [c.encode() for c in word]
        return "".join(self.bytes[b] for p in parts for b in p), list(accumulate(map(len, parts)))

    def _table(self, word: str) -> list[int]:
        """Tokens of each prefix, in characters, of one word."""
        symbols, ends = self._symbols(word)
        counts = self.word_counts(symbols)
        got = [counts[e - 1] for e in ends]
        if word in ("'re", "'ve", "'ll"):  # cut after its second character, it is a quote and a letter
            got[1] = self._table("'")[0] + self._table(word[1])[0]
        return got

    def _changes(self, piece: str) -> bytes:
        word = piece.rstrip(self.blank)
        counts = self._table(word) if word else []
        change = [b - a for a, b in zip([0, *counts], counts, strict=False)]
        if change and not -128 <= min(change) <= max(change) <= 127:
            raise OverflowError(f"a character changes the token count by {max(change, key=abs)}, which a signed byte can't hold")
        return np.array(change + [0] * (len(piece) - len(word)), dtype=np.int8).tobytes()

    def _plain(self, text: str) -> bytes:
        tables = self.tables
        out = []
        for piece in self.word.findall(text.lower()):
            got = tables.get(piece)
            if got is None:
                got = self._changes(piece)
                if len(piece) <= _LONG:
                    if len(tables) > _CACHE:
                        tables.clear()
                    tables[piece] = got
            out.append(got)
        return b"".join(out)

    def _by_library(self, text: str) -> bytes:
        """Changes over the characters of the text as the library normalises and splits it."""
        text = self.library.normalizer.normalize_str(text)
        back = {c: b for b, c in enumerate(self.bytes)}
        out, at = [], 0
        for symbols, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text):
            word = bytes(back[c] for c in symbols).decode()
            out.append(bytes(a - at) + self._changes(word)[: b - a])
            at = b
        return b"".join(out) + bytes(len(text) - at)

    def changes(self, text: str) -> bytes:
        """A signed byte for each character of the normalised text: the change of the token count there.

        A special token's string, matched in the text as given, is one token, which is there
        once the string is complete; cut inside, it is not told apart here.
        """
        out, at = [], 0
        for m in self.special.finditer(text) if self.special and "<|" in text else ():
            out += [self._segment(text[at : m.start()]), bytes(m.end() - m.start() - 1), b"\x01"]
            at = m.end()
        out.append(self._segment(text[at:] if at else text))
        return b"".join(out)

    def _segment(self, text: str) -> bytes:
        if self.plain(text) and (text.isascii() or unicodedata.is_normalized("NFC", text)):
            return self._plain(text)
        return self._by_library(text)


def tokens_at(changes: bytes, chars: int) -> int:
    """Tokens of the first chars characters."""
    return int(np.frombuffer(changes[:chars], np.int8).sum(dtype=np.int64))


def chars_within(changes: bytes, budget: int) -> int:
    """The longest prefix, in characters, of at most budget tokens."""
    total = np.cumsum(np.frombuffer(changes, np.int8), dtype=np.int64)
    fits = np.flatnonzero(total <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_tokens(docs: DataFrame, path: str, budget: int = 2048, keep_prefixes: bool = False) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit and fits of each row of docs.

    fits is the length in characters of the longest prefix of at most budget tokens; where all
    of the text fits, the text's own length, else a place in the normalised text. With
    keep_prefixes, prefixes holds the table: a signed byte a character, in the normalised
    text (where nothing but letter case changes, the text's own characters). Null text:
    empty. Repeated rows each get a row. path is the tokenizer's file, which executors read.
    """
    fields = [("doc_id", "long"), ("n_bytes", "long"), ("n_tokens", "long"), ("over_limit", "boolean"), ("fits", "long")] + [("prefixes", "binary")] * keep_prefixes

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches(rows):
            counter = counter or _counter(path)
            texts = batch.column("text")
            _, offsets = buffers(texts)
            tables, counts, fits = [], [], []
            for text in texts.to_pylist():
                text = text or ""
                counts.append(counter.total(text))
                fits.append(counter.fits(text, budget) if counts[-1] > budget else len(text))
                if keep_prefixes:
                    tables.append(counter.changes(text))
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(counts, pa.int64()), pa.array([n > budget for n in counts], pa.bool_()), pa.array(fits, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(tables, pa.binary())] * keep_prefixes, names=[f for f, _ in fields])

    schema = T.StructType([T.StructField(n, T.DataType.fromDDL(t)) for n, t in fields])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


_counters: dict[str, PrefixCounter] = {}


def _counter(path: str) -> PrefixCounter:
    """One counter a file and worker process: its tables serve all tasks there."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]
