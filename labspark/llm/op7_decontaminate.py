"""Benchmark decontamination: SimHash of item-sized windows, verified by exact similarity.

Benchmark items become bags of shingles and 256-bit SimHash fingerprints. A bag is taken as
a set of numbered shingles (the second "a b c d e" is another element than the first), so
that weighted Jaccard similarity is plain Jaccard similarity of such sets and each element
has one vote on every bit. Each document is read once, as a map, in three steps:

1. Anchors: the shingles that a text shares with an item bound, for every window of the
   item's number of words, the weight that both share. The bound is a count of intervals, so
   it covers all starts, with passages reordered, inserted or repeated.
2. Windows whose bound reaches the threshold are fingerprinted, the best first, and look up a
   multi-index of the items of their size: 8 blocks of 32 bits, of which one must agree to
   within 8 bits. Fingerprints at most 71 bits apart do so, by the pigeonhole principle. At
   the threshold a bit differs with a chance of 0.152, so one window in 10^7 or so lies
   farther; any closer window of the passage is another chance.
3. Candidates are verified by the exact weighted Jaccard similarity of window and item.

The index is broadcast; its size follows the benchmark's words (about 45 bytes each), not
the documents'. Beyond part_words the benchmark is taken in parts, each with its own pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labspark.llm._text import batches, mix, packed, shingles, unpacked, words

WORDS64, BLOCKS, BLOCK_RADIUS = 4, 8, 8
BITS = 64 * WORDS64
#: Items within this many bits of a fingerprint are guaranteed to be found.
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
_SEEDS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_STEP = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class LeakParams:
    """width words a shingle; similarity num/den or more is a leak; part_words bounds what is broadcast at once."""

    width: int = 5
    num: int = 80
    den: int = 100
    part_words: int = 2_000_000


def numbered(hashes: np.ndarray) -> np.ndarray:
    """A bag as a sorted set: each shingle mixed with how many equal ones come before it."""
    own = np.sort(hashes)
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
    often = np.diff(np.concatenate((first, [len(own)])))
    return np.sort(mix(own + (np.arange(len(own)) - np.repeat(first, often)).astype(np.uint64) * _STEP))


def simhash(own: np.ndarray) -> np.ndarray:
    """256-bit fingerprint of a set, as four integers: each bit is set where half of the elements' hashes have it."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(own), 4096):
        raw = mix(own[at : at + 4096, None] ^ _SEEDS[None, :]).view(np.uint8).reshape(-1, BITS // 8)
        ones += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones >= len(own)).view(np.uint64)


class LeakIndex:
    """Items as sets and fingerprints, an inverted index of their shingles, and by size the blocks of their fingerprints."""

    def __init__(self, ids: list[int], texts: list[str | None], params: LeakParams) -> None:
        self.params = params
        self.ids, sizes, grams = [], [], []
        for item, own in zip(ids, words(pa.array(texts, pa.string()), punctuation=False), strict=True):
            if len(own.hashes):
                self.ids.append(item)
                sizes.append(len(own.hashes))
                grams.append(shingles(own.hashes, params.width))
        self.sizes = np.array(sizes, np.int64)
        self.spans = np.minimum(self.sizes, params.width)
        self.weights = np.array([len(g) for g in grams], np.int64)
        self.sets = [numbered(g) for g in grams]
        self.prints = np.array([simhash(s) for s in self.sets], np.uint64).reshape(len(self.sets), WORDS64)
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        self.keys, key = np.unique(flat, return_inverse=True)
        pair, often = np.unique(np.repeat(np.arange(len(grams)), self.weights) * max(1, len(self.keys)) + key, return_counts=True)
        item, key = pair // max(1, len(self.keys)), pair % max(1, len(self.keys))
        #: Keys of each item, ascending, with their counts; and the same entries by key.
        self.item_at = np.searchsorted(item, np.arange(len(grams) + 1))
        self.item_keys, self.item_often = key.astype(np.int32), often.astype(np.int32)
        order = np.argsort(key, kind="stable")
        self.key_at = np.searchsorted(key[order], np.arange(len(self.keys) + 1))
        self.key_items, self.key_often = item[order].astype(np.int32), often[order].astype(np.int32)
        self.groups = {int(n): np.flatnonzero(self.sizes == n) for n in np.unique(self.sizes)}
        self.blocks = {n: np.ascontiguousarray(self.prints[own].view(np.uint32).T) for n, own in self.groups.items()}

    @property
    def nbytes(self) -> int:
        arrays = [self.keys, self.item_at, self.item_keys, self.item_often, self.key_at, self.key_items, self.key_often, self.prints, *self.sets, *self.blocks.values(), *self.groups.values()]
        return sum(a.nbytes for a in arrays)

    def candidates(self, print_: np.ndarray, size: int) -> np.ndarray:
        """Every item of size words within RADIUS bits of a fingerprint."""
        near = np.zeros(len(self.groups[size]), bool)
        for column, own in zip(self.blocks[size], print_.view(np.uint32), strict=True):
            near |= np.bitwise_count(column ^ own) <= BLOCK_RADIUS
        found = self.groups[size][near]
        return found[np.bitwise_count(self.prints[found] ^ print_).sum(axis=1) <= RADIUS]

    def _least(self, item: np.ndarray, n: int) -> np.ndarray:
        """The least weight that item and a window of it share at the threshold, in a text of n shingles."""
        p = self.params
        return -(-p.num * (self.weights[item] + np.minimum(self.weights[item], n)) // (p.num + p.den))

    def _reached(self, key: np.ndarray, span: int, n: int) -> np.ndarray:
        """The items whose shingles a text holds to the weight that they need."""
        once, often = np.unique(key, return_counts=True)
        size = self.key_at[once + 1] - self.key_at[once]
        at = np.arange(size.sum()) + np.repeat(self.key_at[once] - (np.cumsum(size) - size), size)
        items, inverse = np.unique(self.key_items[at], return_inverse=True)
        weight = np.bincount(inverse, np.minimum(np.repeat(often, size), self.key_often[at])).astype(np.int64)
        return items[(weight >= self._least(items, n)) & (self.spans[items] == span)]

    def _starts(self, item: int, place: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
        """Starts of windows that share the needed weight with item, the heaviest first, then the first.

        A shingle that item has c times counts in a window where fewer than c equal ones lie
        between the window's start and it: at starts from just behind the c-th before it, or
        from where the window first reaches it, up to its own place.
        """
        own = slice(self.item_at[item], self.item_at[item + 1])
        at = np.searchsorted(self.item_keys[own], key)
        at[at == own.stop - own.start] = 0
        mine = self.item_keys[own][at] == key
        order = np.argsort(at[mine], kind="stable")
        at, place = at[mine][order], place[mine][order]
        often = self.item_often[own][at]
        first = np.searchsorted(at, at)
        behind = np.arange(len(at)) - often
        width = int(min(self.weights[item], n))
        low = np.maximum(np.where(behind >= first, place[np.maximum(behind, 0)] + 1, 0), np.maximum(place - width + 1, 0))
        starts = np.unique(np.minimum(low, n - width))
        weight = np.searchsorted(np.sort(low), starts, side="right") - np.searchsorted(np.sort(place), starts)
        starts, weight = starts[weight >= self._least(item, n)], weight[weight >= self._least(item, n)]
        return starts[np.lexsort((starts, -weight))]

    def hits(self, hashes: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """Best (similarity, first word, words) by item over the windows of a text's word hashes; ties go to the first."""
        found: dict[int, tuple[float, int, int]] = {}
        for span in np.unique(self.spans).tolist():
            if len(hashes) < span:
                continue
            grams = shingles(hashes, span)
            key = np.searchsorted(self.keys, grams)
            key[key == len(self.keys)] = 0
            place = np.flatnonzero(self.keys[key] == grams)
            if len(place):
                for item in self._reached(key[place], span, len(grams)).tolist():
                    self._windows(item, grams, self._starts(item, place, key[place], len(grams)), len(hashes), found)
        return found

    def _windows(self, item: int, grams: np.ndarray, starts: np.ndarray, n_words: int, found: dict[int, tuple[float, int, int]]) -> None:
        """Looks up the windows at starts until one is found to hold item; keeps what they are found to hold."""
        size, width = int(self.sizes[item]), int(min(self.weights[item], len(grams)))
        for start in starts.tolist():
            bag = numbered(grams[start : start + width])
            near = self.candidates(simhash(bag), size)
            for other in near.tolist():
                both = len(np.intersect1d(bag, self.sets[other], assume_unique=True))
                either = len(bag) + len(self.sets[other]) - both
                if both * self.params.den >= either * self.params.num:
                    _keep(found, self.ids[other], both / either, start, min(size, n_words))
            if item in near:
                return


def _keep(found: dict[int, tuple[float, int, int]], item: int, similarity: float, start: int, n: int) -> None:
    if item not in found or (similarity, -start, n) > (found[item][0], -found[item][1], found[item][2]):
        found[item] = (similarity, start, n)


def _parts(benchmark: DataFrame, params: LeakParams) -> Iterator[tuple[list[int], list[str | None]]]:
    ids, texts, total = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").filter(F.col("item_id").isNotNull()).orderBy("item_id", "text").toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        total += len(row["text"] or "") // 2
        if total > params.part_words:
            yield ids, texts
            ids, texts, total = [], [], 0
    if ids:
        yield ids, texts


HITS = "array<struct<item_id: bigint, similarity: double, first_word: int, n_words: int>>"


def leaks(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """docs with leaks added: for each benchmark item found in the whole text, its best window.

    leaks holds item_id, similarity, first_word and n_words, by item_id; empty where
    nothing was found or the text is null. Words are runs of letters, digits and non-ASCII
    characters, A-Z as a-z. A window has the item's number of words, or the whole text where
    that is shorter; equally similar windows tie to the first. An item of fewer words than a
    shingle is one shingle and must recur whole. Items without words or id are never found;
    of items that share an id the most similar counts. Repeated rows get a row each, texts
    of any length are searched whole, an empty table of either side gives no leaks. A column
    named leaks in docs is replaced; other columns may have any name.
    """
    docs = docs.drop("leaks")
    out = packed(docs).withColumn("leaks", F.expr(f"cast(array() as {HITS})"))
    for ids, texts in _parts(benchmark, params):
        out = _pass(out, LeakIndex(ids, texts, params))
    return unpacked(out, docs.columns, "leaks")


def _pass(docs: DataFrame, index: LeakIndex) -> DataFrame:
    """docs (text, row and leaks) with the leaks of one part of the benchmark joined to those of earlier parts."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int32()), ("n_words", pa.int32())]))

    def find(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches(rows):
            got = []
            for own, before in zip(words(batch.column("text"), punctuation=False), batch.column("leaks").to_pylist(), strict=True):
                hit = index.hits(own.hashes)
                for b in before:
                    _keep(hit, b["item_id"], b["similarity"], b["first_word"], b["n_words"])
                got.append([{"item_id": i, "similarity": s, "first_word": a, "n_words": n} for i, (s, a, n) in sorted(hit.items())])
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("row"), pa.array(got, kind)], names=["text", "row", "leaks"])

    fields = {f.name: f for f in docs.schema.fields}
    return docs.mapInArrow(find, T.StructType([fields["text"], fields["row"], T.StructField("leaks", T.DataType.fromDDL(HITS))]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """The rows of docs in which leaks finds no benchmark item, with their own columns of any name.

    Rows of null or wordless text stay, repeated rows stay or go together.
    """
    return unpacked(leaks(packed(docs), benchmark, params).filter(F.size("leaks") == 0), docs.columns)
