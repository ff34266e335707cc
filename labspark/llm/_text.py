"""Vectorised words and shingle hashes over Arrow string columns.

Words are maximal runs of bytes other than space and the control characters 0x09 to 0x0D;
in UTF-8 no byte of a longer character is one of these. All hashes are functions of the
word's bytes alone, so they agree across batches, tasks and retries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Bytes hashed at once; a slice ends at white space, so only a longer single word exceeds it.
_SLICE = 1 << 20
#: Words of more pieces of eight bytes are hashed one by one, all their pieces at once.
_PIECES = 64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 steps); a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _salt(k: np.ndarray) -> np.ndarray:
    return mix((k.astype(np.uint64) + np.uint64(1)) * _BASE)


def _hash_slice(data: np.ndarray, table: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of data, whose bytes table maps; no word goes on over one of bounds.

    A word's pieces of eight bytes, the last filled with zeros, are each mixed with their
    number and added up, and the sum is mixed with the length: words of one piece never
    collide, longer ones as random numbers do, whatever pattern their letters follow.
    """
    data = table[data]
    there = ~_SPACE[data]
    start, last = there.copy(), there.copy()
    start[1:] &= ~there[:-1]
    last[:-1] &= ~there[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    start[inner], last[inner - 1] = there[inner], there[inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(last) + 1
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    pieces = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = ends - starts
    total = mix((pieces[starts] & _MASK[np.minimum(size, 8)]) ^ _salt(np.zeros(1)))
    more, k = np.flatnonzero(size > 8), 1
    while len(more) and k < _PIECES:
        at = starts[more] + 8 * k
        total[more] += mix((pieces[at] & _MASK[np.minimum(ends[more] - at, 8)]) ^ _salt(np.array([k])))
        k += 1
        more = more[size[more] > 8 * k]
    for i in more.tolist():
        at = np.arange(starts[i] + 8 * k, ends[i], 8)
        total[[i]] += mix((pieces[at] & _MASK[np.minimum(ends[i] - at, 8)]) ^ _salt(k + np.arange(len(at)))).sum(keepdims=True)
    return starts, ends, mix(total + size.astype(np.uint64) * _BASE)


class Words:
    """The words of one text: byte starts and ends within it, and 64-bit hashes."""

    __slots__ = ("ends", "hashes", "starts")

    def __init__(self, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        self.starts, self.ends, self.hashes = starts, ends, hashes


def words(column: pa.Array, lower: bool = True, punctuation: bool = True) -> Iterator[Words]:
    """The words of each text of a string column, in order; a null has none.

    lower maps A-Z to a-z. Without punctuation, ASCII marks other than letters and digits
    count as white space.
    """
    data, offsets = buffers(column)
    table = _LOWER if lower else np.arange(256, dtype=np.uint8)
    if not punctuation:
        table = table.copy()
        table[[c for c in range(128) if not chr(c).isalnum()]] = 0x20
    at = 0
    while at < len(offsets) - 1:
        last = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _SLICE, side="right")) - 1)
        first, end = int(offsets[at]), int(offsets[last])
        if end - first <= 2 * _SLICE:
            own = offsets[at : last + 1] - first
            starts, ends, hashes = _hash_slice(data[first:end], table, own)
            cut = np.searchsorted(starts, own)
            for i in range(last - at):
                a, b = cut[i], cut[i + 1]
                yield Words(starts[a:b] - own[i], ends[a:b] - own[i], hashes[a:b])
        else:
            yield _long(table, data[first:end])
        at = last


def _long(table: np.ndarray, data: np.ndarray) -> Words:
    parts, at = [], 0
    none = np.zeros(0, np.int64)
    while at < len(data):
        end = min(at + _SLICE, len(data))
        while end < len(data) and not _SPACE[table[data[end]]]:
            end += 1
        starts, ends, hashes = _hash_slice(data[at:end], table, none)
        parts.append((starts + at, ends + at, hashes))
        at = end
    return Words(*(np.concatenate([p[i] for p in parts]) for i in range(3)))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of width words; with fewer words the whole text is one shingle."""
    n = len(hashes)
    if n == 0:
        return hashes
    span = min(n, width)
    out = np.full(n - span + 1, span, np.uint64)
    for k in range(span):
        out = mix(out * _BASE + hashes[k : n - span + 1 + k])
    return out


def batches(rows: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes, so that long texts don't add up."""
    for batch in rows:
        step = max(1, min(batch.num_rows, int(batch.num_rows * limit / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def named(name: str) -> Column:
    """The column of a name that may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame) -> DataFrame:
    """docs as text and row, a struct of all other columns, so that no name of theirs can clash."""
    return docs.select("text", F.struct(*(named(c) for c in docs.columns if c != "text")).alias("row"))


def unpacked(df: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """The columns that packed put away, in the order given, and more columns of df."""
    return df.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in columns), *more)


#: Rows of a bucket table at most, whatever the input: what may be broadcast without a look at its size.
BUCKETS = 1 << 20


def bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def buckets(keys: DataFrame, key: str) -> DataFrame:
    """The hash buckets that hold a key, to broadcast: other rows need not reach the shuffle of a join on it."""
    return F.broadcast(keys.select(bucket(F.col(key)).alias("bucket")).distinct())
