"""N-gram Jaccard join: a parity-sketch join with exact verification.

Every text becomes the set of hashes of its word shingles. Sets are dealt to overlapping
size bands, so that two sets that can reach the threshold meet in one band. In a band the
hash space is cut into m blocks and the hashes of each block are XORed: an element of the
symmetric difference changes one block, so the number of differing blocks is at most that
difference. The threshold bounds it by D < m, and by the pigeonhole principle linked sets
agree in a block: an equal join on (band, block, parity word) misses no link.

A doc's blocks without elements would meet everyone's, so they are emitted only where its
other blocks are too few (D or fewer) to give the guarantee by themselves.

Rows are dealt by ranges of key and set, so that a hot key spreads over tasks, and groups of
equal keys are met as a sorted stream. Pairs in a group must pass a bit-parity
sketch (an element flips one bit, so the Hamming distance is again at most the symmetric
difference) before they count as candidate edges. A small group gives its few pairs; the
members of a large one meet in blocks of bounded size, which give a spanning forest of the
pairs that pass. Every link so lies within a component of the candidate edges, a cluster.

Clusters are compared by their words, in blocks whose links leave as spanning forests. A
small cluster is one block. The members of a large one first meet its hub, the member of
most candidate edges, and those not linked to it their best neighbour among those that are:
so each text is sent a few times and nearly all are linked. Only members that are still
apart then meet all of the cluster, block by block. No step holds an unbounded group or
emits all pairs of one, and no step drops a candidate.

Hashes only propose. Sets count as equal by 128 bits, of which the half that serves as key
is looked through for clashes; every other link is decided on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labspark.llm._text import batches, bucket, buckets, mix, packed, shingles, unpacked, words
from labspark.operators.components import components
from labspark.session import discard, materialise


@dataclass(frozen=True)
class JaccardParams:
    """Shingles of width words; sets link where den * |intersection| >= num * |union|."""

    width: int = 5
    num: int = 80
    den: int = 100
    small_group: int = 8
    sketch_rows: int = 512
    chunk_rows: int = 128
    chunk_shingles: int = 250_000


def _bands(params: JaccardParams) -> np.ndarray:
    """Lower bounds of the size bands, growing by half."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return np.array(out, dtype=np.int64)


def _plan(band: int, lows: np.ndarray, params: JaccardParams) -> tuple[int, int]:
    """(D, m) of a band: the largest symmetric difference of a linked pair, and the blocks."""
    top = int(lows[band + 1]) - 1
    d = (top + top * params.den // params.num) * (params.den - params.num) // (params.den + params.num)
    return d, 1 if d == 0 else d + 1 + max(4, d // 16)


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    for own in words(column):
        yield np.unique(shingles(own.hashes, width))


def digest(own: np.ndarray) -> tuple[int, int]:
    """A 128-bit digest of a sorted set, as two signed integers; equal sets have equal ones."""
    a = np.bitwise_xor.reduce(mix(own ^ np.uint64(0x5851F42D4C957F2D)))
    b = np.add.reduce(mix(own + np.uint64(0x14057B7EF767814F)))
    both = np.array([a, b + np.uint64(len(own))])
    low = mix(both ^ mix(both[::-1]))
    return int(low[0].view(np.int64)), int(low[1].view(np.int64))


def _keys(own: np.ndarray, lows: np.ndarray, params: JaccardParams) -> np.ndarray:
    """The join keys of a set: one for each block in each of its one or two bands."""
    n = len(own)
    home = int(np.searchsorted(lows, n, side="right")) - 1
    out = []
    for band in (home, home - 1):
        if band < 0 or band < home and n * params.num > (int(lows[home]) - 1) * params.den:
            continue
        d, m = _plan(band, lows, params)
        block = ((own >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # rises with the hash
        first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        parity = np.bitwise_xor.reduceat(mix(own), first)
        filled = block[first]
        if len(filled) <= d:
            parity = np.concatenate((parity, np.zeros(m - len(filled), np.uint64)))
            filled = np.concatenate((filled, np.setdiff1d(np.arange(m, dtype=np.uint64), filled)))
        out.append(mix(mix(parity + np.uint64(band)) + mix(filled + (np.uint64(band) << np.uint64(40)))))
    return np.concatenate(out).view(np.int64)


def _bits(own: np.ndarray) -> bytes:
    """Parity sketch of a set: as many bits as four times its size, rounded up to a power of two."""
    bits = max(64, 1 << (4 * len(own) - 1).bit_length() >> 1)
    odd = np.bincount((mix(own ^ np.uint64(0xD1342543DE82EF95)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _hamming(a: bytes, b: bytes) -> int:
    """Distance of two sketches; the longer is folded by XOR, which keeps parities."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    # packbits is big-endian within bytes, so folding halves keeps bit i on bit i mod the length.
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def shingle_sets(docs: DataFrame, params: JaccardParams) -> DataFrame:
    """doc_id, n_shingles, node and check (a digest's halves, null for the empty set), sketch and keys of each row.

    A task leaves out sketch and keys of sets that it has met before, so that copies
    shrink to one entry a task before anything is shuffled.
    """
    lows = _bands(params)

    def build(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        for batch in batches(rows):
            if len(met) > 1 << 18:
                met.clear()
            sizes, nodes, sketches, keys = [], [], [], []
            for own in _sets(batch.column("text"), params.width):
                node = digest(own) if len(own) else (None, None)
                fresh = len(own) > 0 and node not in met
                sizes.append(len(own))
                nodes.append(node)
                sketches.append(_bits(own) if fresh else None)
                keys.append(_keys(own, lows, params) if fresh else np.zeros(0, np.int64))
                met.add(node)
            offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array([n[0] for n in nodes], pa.int64()), pa.array([n[1] for n in nodes], pa.int64()),
                    pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                names=["doc_id", "n_shingles", "node", "check", "sketch", "keys"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, "doc_id long, n_shingles long, node long, check long, sketch binary, keys array<long>")


def _told_apart(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sets, and its nodes (node, check, rep, n, sketch); different sets of one node get nodes of their own."""
    while True:
        there = sets.filter(F.col("node").isNotNull())
        both = there.groupBy("node").agg(F.min("check").alias("check"), F.max("check").alias("other"), F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch"))
        nodes = materialise(both, "nodes")
        clash = nodes.filter("check <> other").select("node", F.lit(True).alias("clash"))
        if clash.isEmpty():
            return sets, nodes.drop("other")
        # One clash is expected at some 10^9.5 different sets.
        anew = F.when(F.col("clash"), F.xxhash64("node", "check")).otherwise(F.col("node"))
        sets = materialise(sets.join(clash, "node", "left").withColumn("node", anew).drop("clash"), "sets")


def _group_edges(params: JaccardParams):
    """From rows (key, node) sorted by both: the pairs (a, b) of small groups, and of large ones the members, as (key, a).

    The first and the last group of a task may go on in its neighbours, so they count as large.
    """
    small = params.small_group

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, big = np.zeros(0, np.int64), np.zeros(0, np.int64), True
        for batch in rows:
            key = np.concatenate((key, batch.column("key").to_numpy(zero_copy_only=False)))
            node = np.concatenate((node, batch.column("node").to_numpy(zero_copy_only=False)))
            fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1]))) if len(key) else np.zeros(0, bool)
            key, node = key[fresh], node[fresh]
            if not len(key):
                continue
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.concatenate((first, [len(key)])))
            is_big = size > small
            is_big[0] |= big
            # The last group may go on in the next batch: a small one waits, a large one leaves its last member.
            if len(first) > 1 or is_big[-1]:
                done = slice(0, len(first) if is_big[-1] else len(first) - 1)
                yield from _emit(key, node, first[done], size[done], is_big[done], small)
            big = bool(is_big[-1])
            rest = len(key) - 1 if big else int(first[-1])
            key, node = key[rest:], node[rest:]
        if len(key):
            yield from _emit(key, node, np.array([0]), np.array([len(key)]), np.array([True]), small)

    return run


def _emit(key: np.ndarray, node: np.ndarray, first: np.ndarray, size: np.ndarray, is_big: np.ndarray, small: int) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for k in range(1, small):
        at = first[(size > k) & ~is_big]
        width = size[(size > k) & ~is_big] - k
        left = np.repeat(at, width) + (np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width))
        a.append(node[left])
        b.append(node[left + k])
    a, b = np.concatenate(a), np.concatenate(b)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["key", "a", "b"])
    member = np.repeat(is_big, size)
    if member.any():
        own = slice(int(first[0]), int(first[0]) + len(member))
        yield pa.RecordBatch.from_arrays([pa.array(key[own][member]), pa.array(node[own][member]), pa.nulls(int(member.sum()), pa.int64())], names=["key", "a", "b"])


def _forest(hit_row, n: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of a graph on 0 to n - 1; hit_row(i) tells which j > i are neighbours."""
    label = np.arange(n)
    for i in range(n - 1):
        near = np.flatnonzero(hit_row(i)) + i + 1
        if len(near):
            new, first = np.unique(label[near], return_index=True)
            for other, j in zip(new, near[first], strict=True):
                if other != label[i]:
                    label[label == other] = label[i]
                    yield i, int(j)


def _sketch_forest(rows: list[tuple[int, int, bytes]], params: JaccardParams) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs of (node, size, sketch) that their sketches don't rule out."""
    if len(rows) < 2:
        return
    width = min(len(r[2]) for r in rows)
    bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(r[2], np.uint8).reshape(-1, width), axis=0) for r in rows]).view(np.uint64)
    size = np.array([r[1] for r in rows], dtype=np.int64)

    def near(i: int) -> np.ndarray:
        far = (size[i] + size[i + 1 :]) * (params.den - params.num) // (params.den + params.num)
        fits = np.minimum(size[i], size[i + 1 :]) * params.den >= np.maximum(size[i], size[i + 1 :]) * params.num
        return fits & (np.bitwise_count(bits[i] ^ bits[i + 1 :]).sum(axis=1, dtype=np.int64) <= far)

    for i, j in _forest(near, len(rows)):
        yield rows[i][0], rows[j][0]


def _edges_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def _large_groups(params: JaccardParams):
    """Candidate edges of large groups; rows come sorted by (key, i, j, node)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in rows:
            found = []
            for key, i, j, node, n, sketch in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "node", "n", "sketch")), strict=True):
                if (key, i, j) != now:
                    found += _sketch_forest(held, params)
                    now, held = (key, i, j), []
                held.append((node, n, sketch))
            yield _edges_of(found)
        yield _edges_of(list(_sketch_forest(held, params)))

    return run


def _near(params: JaccardParams):
    """Drops pairs whose sketches prove them too far apart."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            keep = []
            for na, nb, sa, sb in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")), strict=True):
                far = (na + nb) * (params.den - params.num) // (params.den + params.num)
                keep.append(min(na, nb) * params.den >= max(na, nb) * params.num and _hamming(sa, sb) <= far)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def linked(sets: list[np.ndarray], params: JaccardParams) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among sorted sets, by exact intersection sizes."""
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    if n <= 6:

        def near(i: int) -> np.ndarray:
            both = np.array([len(np.intersect1d(sets[i], other, assume_unique=True)) for other in sets[i + 1 :]], dtype=np.int64)
            return params.den * both >= params.num * (size[i] + size[i + 1 :] - both)

        yield from _forest(near, n)
        return
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), size)
    _, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = often[column] > 1  # the rest adds to no intersection
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    both = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        dense = np.zeros((n, width), np.float32)
        dense[row[lo:hi], column[lo:hi] - at] = 1
        both += dense @ dense.T
    both = np.rint(both).astype(np.int64)
    yield from _forest(lambda i: params.den * both[i, i + 1 :] >= params.num * (size[i] + size[i + 1 :] - both[i, i + 1 :]), n)


def exact_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The shingle sets of texts as integers that are equal where the words are.

    Words are numbered from 1 in the order of their first use; a text of fewer words than a
    shingle is filled up with 0. As many numbers as fit go into one integer; where a shingle
    needs more, the integers so far are replaced by their ranks.
    """
    known: dict[bytes, int] = {}
    rows = [[known.setdefault(w, len(known) + 1) for w in text.lower().split()] for text in texts]
    rows = [r + [0] * (width - len(r)) if r else [] for r in rows]
    at = np.cumsum([0] + [len(r) for r in rows])
    flat = np.fromiter((w for r in rows for w in r), np.int64, int(at[-1]))
    n, size = len(flat) - width + 1, len(known).bit_length()
    if n <= 0:
        return [flat[:0] for _ in rows]
    out, used = flat[:n].copy(), size
    for k in range(1, width):
        if used + size > 62:
            _, out = np.unique(out, return_inverse=True)
            used = int(n).bit_length()
        out = (out << size) | flat[k : n + k]
        used += size
    return [np.unique(out[a : b - width + 1]) if b > a else flat[:0] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _verify(params: JaccardParams):
    """Links within each block of a cluster; rows come sorted by (cluster, i, j, node)."""

    def links(hub: int | None, held: dict[int, list]) -> list[tuple[int, int]]:
        nodes = list(held)
        found = [(nodes[x], nodes[y]) for x, y in linked(exact_sets([_text_of(own, params) for own in held.values()], params.width), params)]
        return found if hub not in held else found + [(hub, n) for n in _tree(hub, found) if n != hub]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches(rows):
            found = []
            at = zip(*(batch.column(c).to_pylist() for c in ("cluster", "i", "j", "node", "check")), batch.column("text").cast(pa.binary()).to_pylist(), strict=True)
            for cluster, i, j, node, check, text in at:
                if (cluster, i, j) != now:
                    found += links(now and now[0], held)
                    now, held = (cluster, i, j), {}
                if text is not None and (check, text) not in (own := held.setdefault(node, [])):
                    own.append((check, text))
            yield _edges_of(found)
        yield _edges_of(links(now and now[0], held))

    return run


def _tree(root: int, edges: list[tuple[int, int]]) -> set[int]:
    """The nodes that edges connect with root."""
    beside: dict[int, list[int]] = {}
    for a, b in edges:
        beside.setdefault(a, []).append(b)
        beside.setdefault(b, []).append(a)
    known, todo = {root}, [root]
    while todo:
        for n in beside.get(todo.pop(), ()):
            if n not in known:
                known.add(n)
                todo.append(n)
    return known


def _text_of(own: list[tuple[int, bytes]], params: JaccardParams) -> bytes:
    """The text of a node among those of the rows that share its doc_id."""
    if len(own) > 1:
        for (check, text), hashes in zip(own, _sets(pa.array([t for _, t in own], pa.binary()), params.width), strict=True):
            if len(hashes) and digest(hashes)[1] == check:
                return text
    return own[0][1]


def _blocks(rows: DataFrame, chunks: str) -> DataFrame:
    """rows dealt to chunks of their key by node, once for each pair (i, j) of chunks that meets."""
    return (
        rows.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col(chunks)).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col(chunks) - 1)))
        .withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
    )


def _links(docs: DataFrame, dealt: DataFrame, params: JaccardParams) -> DataFrame:
    """The links (a, b) within each block (cluster, i, j) of dealt (with node, check and rep, whose text is compared).

    A block whose cluster is a node that it holds also gives (cluster, b) for all that are linked to that node.
    """
    dealt = materialise(dealt.select("cluster", "i", "j", "node", "check", F.col("rep").alias("doc_id")), "dealt")
    texts = docs.select(F.col("doc_id").cast("long"), "text").withColumn("bucket", bucket(F.col("doc_id"))).join(buckets(dealt, "doc_id"), "bucket", "left_semi")
    links = (
        texts.join(dealt, "doc_id")
        .select("cluster", "i", "j", "node", "check", "text")
        .repartitionByRange("cluster", "i", "j")  # evenly filled, with each block in one piece
        .sortWithinPartitions("cluster", "i", "j", "node")
        .mapInArrow(_verify(params), "a long, b long")
    )
    links = materialise(links, "links")
    discard(dealt)
    return links


def _chunks(params: JaccardParams):
    return F.greatest(F.ceil(F.count("*") / params.chunk_rows), F.ceil(F.sum("n") / params.chunk_shingles)).cast("int")


def _by_hub(wanted: DataFrame, rows: DataFrame, params: JaccardParams) -> DataFrame:
    """Blocks of wanted (rows with a hub) in chunks by hub, with the hub itself in each chunk."""
    shape = materialise(wanted.groupBy("hub").agg(_chunks(params).alias("chunks")), "shape")
    part = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    zero = F.lit(0).alias("j")
    own = wanted.join(shape, "hub").select(F.col("hub").alias("cluster"), part.alias("i"), zero, "node", "check", "rep")
    hubs = shape.join(rows, shape["hub"] == rows["node"]).select(F.col("hub").alias("cluster"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i"), zero, "node", "check", "rep")
    return own.unionByName(hubs)


def _crowded_links(docs: DataFrame, rows: DataFrame, near: DataFrame, whole: DataFrame, params: JaccardParams) -> list[DataFrame]:
    """Links of the blocks of whole, and of large clusters: rows (node, component_of, check, rep, n) near the candidate edges."""
    edges = near.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(near.select(F.col("b").alias("node"), F.col("a").alias("other")))
    degree = edges.groupBy("node").agg(F.count("*").alias("degree"))
    rows = materialise(rows.join(degree, "node"), "degrees")
    hubs = materialise(rows.groupBy("component_of").agg(F.max(F.struct("degree", "node"))["node"].alias("hub")), "hubs")
    first = materialise(rows.join(hubs, "component_of"), "first")
    links = _links(docs, whole.unionByName(_by_hub(first, rows, params)), params)
    # Parts by the hub: what the blocks found linked to it, and the hub.
    joined = links.join(hubs.select(F.col("hub").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).unionByName(hubs.select(F.col("hub").alias("node"))).distinct()
    joined = materialise(joined, "joined")
    apart = materialise(first.drop("hub").join(joined, "node", "left_anti"), "apart")
    found = [links]
    if apart.isEmpty():
        return found
    # Their best neighbour among the rest, but for the hub, which they have met.
    others = first.filter(F.col("node") != F.col("hub")).join(joined, "node", "left_semi").select(F.col("node").alias("other"), "degree")
    ranked = edges.join(apart.select("node"), "node", "left_semi").join(others, "other")
    second = materialise(ranked.groupBy("node").agg(F.max(F.struct("degree", "other"))["other"].alias("hub")).join(apart, "node"), "second")
    if not second.isEmpty():
        links = _links(docs, _by_hub(second, rows, params), params)
        found.append(links)
        more = links.join(second.select(F.col("hub").alias("a")).distinct(), "a", "left_semi").select(F.col("b").alias("node"))
        apart = materialise(apart.join(more, "node", "left_anti"), "apart")
        if apart.isEmpty():
            return found
    # What is still apart meets all of its cluster.
    few = materialise(apart.groupBy("component_of").agg(_chunks(params).alias("few")), "shape")
    many = materialise(rows.join(few, "component_of").groupBy("component_of").agg(_chunks(params).alias("many"), F.max("few").alias("few")), "shape")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    columns = (F.col("component_of").alias("cluster"), "i", "j", "node", "check", "rep")
    asking = apart.join(many, "component_of").select("*", own("few").alias("i"), spread("many").alias("j")).select(*columns)
    asked = rows.join(many, "component_of").select("*", spread("few").alias("i"), own("many").alias("j")).select(*columns)
    return [*found, _links(docs, asking.unionByName(asked), params)]


def jaccard_components(docs: DataFrame, params: JaccardParams = JaccardParams()) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of each row.

    Null or wordless text: the empty set, its own component. Fewer words than a shingle has:
    the whole sequence is the one shingle. Equal sets link. Repeated rows each get a row.
    A null doc_id joins its component but never names it unless all its members' ids are null.
    Words are split at ASCII white space after A-Z became a-z. Texts and words of any length
    are taken whole, an empty table gives an empty one, and other columns are not looked at.
    """
    sets, nodes = _told_apart(materialise(shingle_sets(docs, params), "sets"))
    small = sets.select("doc_id", "n_shingles", "node")
    there = sets.filter(F.col("node").isNotNull())
    keyed = there.select("node", F.explode("keys").alias("key")).repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    met = materialise(keyed.mapInArrow(_group_edges(params), "key long, a long, b long"), "met")
    side = lambda c, n, s: nodes.select(F.col("node").alias(c), F.col("n").alias(n), F.col("sketch").alias(s))
    pairs = met.filter(F.col("key").isNull()).select("a", "b").distinct()
    near = pairs.join(side("a", "na", "sa"), "a").join(side("b", "nb", "sb"), "b").mapInArrow(_near(params), "a long, b long")
    large = met.filter(F.col("key").isNotNull()).select("key", F.col("a").alias("node")).distinct()
    sizes = materialise(large.groupBy("key").agg(F.ceil(F.count("*") / params.sketch_rows).cast("int").alias("chunks")), "sizes")
    crowd = _blocks(large.join(sizes, "key"), "chunks").select("key", "i", "j", "node").join(nodes.select("node", "n", "sketch"), "node")
    forests = crowd.repartitionByRange("key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInArrow(_large_groups(params), "a long, b long")
    near = materialise(near.unionByName(forests), "near")
    discard(met, sizes)

    members = materialise(components(near).join(nodes.select("node", "check", "rep", "n"), "node").withColumnRenamed("component", "component_of"), "members")
    shape = materialise(members.groupBy("component_of").agg(_chunks(params).alias("chunks")), "shape")
    whole = members.join(shape.filter("chunks = 1"), "component_of").select(F.col("component_of").alias("cluster"), F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "check", "rep")
    crowded = materialise(members.join(shape.filter("chunks > 1"), "component_of").drop("chunks"), "crowded")
    links = [_links(docs, whole, params)] if crowded.isEmpty() else _crowded_links(docs, crowded, near, whole, params)
    linked_ = links[0]
    for more in links[1:]:
        linked_ = linked_.unionByName(more)
    named = materialise(components(linked_).join(nodes.select("node", "rep"), "node"), "named")
    best = materialise(named.groupBy("component").agg(F.min("rep").alias("best")), "best")
    label = nodes.select("node", "rep").join(named.join(best, "component").select("node", "best"), "node", "left").select("node", F.coalesce("best", "rep").alias("component_id"))
    label = materialise(label, "labels")
    discard(near, members, shape, crowded, named, best, *links)
    return (
        small.filter(F.col("node").isNotNull())
        .join(label, "node")
        .select("doc_id", "n_shingles", "component_id")
        .unionByName(small.filter(F.col("node").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    )


def keep_one(docs: DataFrame, params: JaccardParams = JaccardParams()) -> DataFrame:
    """The rows of docs whose doc_id names their component: one of each group of near copies.

    Rows that repeat a kept doc_id are reduced to the one whose values come first by hash; rows
    without a doc_id are kept as they are, as nothing can name them, and so are rows of null
    or wordless text, each its own group. Other columns of docs may have any name.
    """
    found = materialise(jaccard_components(docs.filter(F.col("doc_id").isNotNull()), params), "found")
    goes = F.col("doc_id") != F.col("component_id")
    odd = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(goes).alias("goes")).filter("n > 1 OR goes")
    near = materialise(buckets(odd, "doc_id"), "odd")
    identity = F.col("row.doc_id").cast("long")
    rows = packed(docs).select(identity.alias("id"), F.xxhash64("text", "row").alias("hash"), bucket(identity).alias("bucket"), "text", "row")
    # Most rows have an id of their own that stays, and none of a bucket with others: they pass as they are.
    sure = rows.join(F.broadcast(near), "bucket", "left_anti")
    unsure = rows.filter(F.col("id").isNotNull()).join(F.broadcast(near), "bucket", "left_semi")
    kept = found.filter(~goes).select(F.col("doc_id").alias("id")).distinct()
    first = materialise(unsure.select("id", "hash").join(kept, "id", "left_semi").groupBy("id").agg(F.min("hash").alias("hash")), "first")
    once = unsure.join(first, ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"])
    lost = rows.filter(F.col("id").isNull()).join(F.broadcast(near), "bucket", "left_semi")
    return unpacked(sure.unionByName(once).unionByName(lost), docs.columns)
