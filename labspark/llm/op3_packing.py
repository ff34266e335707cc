"""Token-ID output: best-fit-decreasing packing into fixed-width id matrices.

Texts are encoded by a public byte-level tokenizer file. A document longer than a row is cut
into pieces of a row's width, so that no id is lost; each piece goes to the open row that it
fills best, which a segment tree over remaining capacities finds in logarithmic time.

Packing works on bounded buffers of tokens within a task: rows need no shuffle, memory does
not grow with the input, and a retried task gives the same rows. At most the last rows of
each buffer are not full.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark.llm._text import batches


def _default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@dataclass(frozen=True)
class PackParams:
    """width ids a row; buffer bounds the ids that are packed together; pad fills rows and ends documents."""

    ranks: str = field(default_factory=_default_ranks)
    width: int = 2048
    buffer: int = 1 << 21
    pad: int = 50256
    end_document: bool = True


def encoder(path: str):
    """The tiktoken encoding of a rank file; special strings in texts are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Capacities:
    """Open rows by remaining capacity, with a segment tree over the capacities 0 to width."""

    def __init__(self, width: int) -> None:
        self.leaves = 1 << width.bit_length()
        self.tree = [False] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        at = capacity + self.leaves
        while at and not self.tree[at]:
            self.tree[at] = True
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row of least capacity that holds need, removed, as (capacity, row)."""
        at = need + self.leaves
        if not self.tree[at]:
            # Up to the first ancestor with a filled right sibling, then down its left edge.
            while at > 1 and (at & 1 or not self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        row = self.rows[capacity].pop()
        if not self.rows[capacity]:
            self.tree[at] = False
            at >>= 1
            while at:
                self.tree[at] = self.tree[2 * at] or self.tree[2 * at + 1]
                at >>= 1
        return capacity, row


def best_fit_decreasing(lengths: np.ndarray, width: int) -> list[list[int]]:
    """Rows as lists of piece numbers; every length is 1 to width."""
    open_rows, rows = Capacities(width), []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[piece])
        found = open_rows.take(need)
        if found is None:
            found = (width, len(rows))
            rows.append([])
        capacity, row = found
        rows[row].append(piece)
        if capacity > need:
            open_rows.add(capacity - need, row)
    return rows


SCHEMA = "input_ids array<int>, position_ids array<int>, cu_seqlens array<int>, doc_ids array<long>, doc_starts array<int>, n_tokens int"


def _packed(pieces: list[tuple[int | None, int, np.ndarray]], params: PackParams) -> pa.RecordBatch:
    lengths = np.array([len(p[2]) for p in pieces], dtype=np.int64)
    rows = best_fit_decreasing(lengths, params.width)
    n = len(rows)
    ids = np.full((n, params.width), params.pad, np.int32)
    places = np.zeros((n, params.width), np.int32)
    count = np.arange(params.width, dtype=np.int32)
    ends, docs, starts, total = [], [], [], []
    for r, row in enumerate(rows):
        at, own = 0, [0]
        for p in row:
            doc, start, tokens = pieces[p]
            ids[r, at : at + len(tokens)] = tokens
            places[r, at : at + len(tokens)] = count[: len(tokens)]
            at += len(tokens)
            own.append(at)
            docs.append(doc)
            starts.append(start)
        ends.append(own)
        total.append(at)
    sizes = np.array([len(r) for r in rows], dtype=np.int32)
    per_row = lambda extra: pa.array(np.concatenate(([0], np.cumsum(sizes + extra))).astype(np.int32))
    fixed = pa.array(np.arange(n + 1, dtype=np.int32) * params.width)
    return pa.RecordBatch.from_arrays(
        [
            pa.ListArray.from_arrays(fixed, pa.array(ids.ravel())),
            pa.ListArray.from_arrays(fixed, pa.array(places.ravel())),
            pa.ListArray.from_arrays(per_row(1), pa.array(np.concatenate([np.array(e, np.int32) for e in ends]))),
            pa.ListArray.from_arrays(per_row(0), pa.array(docs, pa.int64())),
            pa.ListArray.from_arrays(per_row(0), pa.array(starts, pa.int32())),
            pa.array(total, pa.int32()),
        ],
        names=["input_ids", "position_ids", "cu_seqlens", "doc_ids", "doc_starts", "n_tokens"],
    )


def pack(docs: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """Rows of exactly width ids, with what is needed to take them apart again.

    input_ids is padded with pad; cu_seqlens are cumulative lengths of the pieces (from 0 to
    n_tokens); position_ids restart at 0 with each piece; doc_ids and doc_starts name each
    piece's document and its first id's place in that document. With end_document each
    document ends in one pad id. Null and empty texts hold that id alone, or give nothing
    without it. Repeated rows are packed each; a null doc_id stays null; an empty table gives
    an empty one; other columns are not read. Very long texts are split over rows and lose no
    id. Of pieces of one length the earlier is placed first, of rows of one capacity the one
    that last came to it takes the piece.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(params.ranks)
        held, size = [], 0
        for batch in batches(rows):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                at = 0
                for part in _encoded(tokenizer, text or ""):
                    # Only the last id run of a document may be shorter than it is cut below.
                    held.append([doc, at, part])
                    at += len(part)
                    size += len(part)
                if params.end_document:
                    held.append([doc, at, np.array([params.pad], np.int32)])
                    size += 1
            if size >= params.buffer:
                yield from _flush(held, params)
                held, size = [], 0
        if held:
            yield from _flush(held, params)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def _encoded(tokenizer, text: str) -> Iterator[np.ndarray]:
    """The ids of a whole text, in runs.

    A line break between another than white space and a letter is a piece by itself in the
    tokenizer's pattern, so cutting a very long text there changes no id; a text without
    such breaks stays whole.
    """
    step = 1 << 18
    at = 0
    while at < len(text):
        end = min(len(text), at + step)
        while end < len(text) and not (text[end - 1] == "\n" and not text[end - 2].isspace() and text[end].isalpha() and text[end].isascii()):
            nxt = text.find("\n", end)
            end = len(text) if nxt < 0 else nxt + 1
        yield np.array(tokenizer.encode_ordinary(text[at:end]), dtype=np.int32)
        at = end


def _flush(held: list[list], params: PackParams) -> Iterator[pa.RecordBatch]:
    """Joins the runs of each document, cuts them to row width, and packs a bounded number at a time."""
    pieces: list[tuple[int | None, int, np.ndarray]] = []
    i = 0
    while i < len(held):
        j = i + 1
        while j < len(held) and held[j][1] > 0:
            j += 1
        tokens = np.concatenate([h[2] for h in held[i:j]])
        for at in range(0, len(tokens), params.width):
            pieces.append((held[i][0], at, tokens[at : at + params.width]))
        i = j
    if pieces:
        packed = _packed(pieces, params)
        for at in range(0, packed.num_rows, 256):
            yield packed.slice(at, 256)


def write_bin(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet with the ids as little-endian 32-bit binary, a matrix row each.

    Values stay in place: the column bytes of consecutive rows are the matrix in row order.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            as_bytes = [[np.array(v, "<i4").tobytes() for v in batch.column(c).to_pylist()] for c in ("input_ids", "position_ids", "cu_seqlens")]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(b, pa.binary()) for b in as_bytes), batch.column("doc_ids"), batch.column("doc_starts"), batch.column("n_tokens")],
                names=["input_ids", "position_ids", "cu_seqlens", "doc_ids", "doc_starts", "n_tokens"],
            )

    packed.mapInArrow(run, "input_ids binary, position_ids binary, cu_seqlens binary, doc_ids array<long>, doc_starts array<int>, n_tokens int").write.parquet(path)


def read_bin(spark: SparkSession, path: str) -> DataFrame:
    """What write_bin wrote, with the ids as arrays again."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            back = [pa.array([np.frombuffer(v, "<i4") for v in batch.column(c).to_pylist()], pa.list_(pa.int32())) for c in ("input_ids", "position_ids", "cu_seqlens")]
            yield pa.RecordBatch.from_arrays([*back, batch.column("doc_ids"), batch.column("doc_starts"), batch.column("n_tokens")], names=["input_ids", "position_ids", "cu_seqlens", "doc_ids", "doc_starts", "n_tokens"])

    return spark.read.parquet(path).mapInArrow(run, SCHEMA)
