"""Exact top-k search by inner product over a pivot-distance index.

Vectors get one more component that lifts all to the same norm M; the inner product with a
query q then falls with the Euclidean distance: 2 q.x = |q|^2 + M^2 - d(q, x)^2. Each
vector is keyed by its nearest pivot and its distance to it, and the distances of a pivot
are cut into annuli. By the triangle inequality a vector at distance r from pivot p is at
least |d(q, p) - r| from q, which bounds its score from above.

A query starts with a threshold, the k-th best of a bounded sample of real rows, and takes
the annuli in the order of their bounds until the next bound is below the threshold. Queries
travel in blocks to the annuli that they need; an annulus comes in blocks of bounded size,
and a large one is dealt to several keys, each of which gets the queries, so no task holds
all of it. Blocks hold the narrowest integers that fit, messages are of bounded size, and a
task passes on only what can still be among a query's best of those it has seen. Pivots grow
with the rows. All rows are indexed; the sample chooses pivots and
starting thresholds alone and bears on the speed, not the result.

Distances and bounds are taken on vectors divided by the largest component, so that none
overflows, with a margin for rounding. The products are exact integers at any size: where
float64 can't hold them, components are cut into limbs whose products it holds.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labspark.session import materialise


@dataclass(frozen=True)
class TopKParams:
    """sample bounds the rows that pivots and starting thresholds come from; annuli is for each pivot.

    There are a sixteenth of the root of the rows as pivots, from pivots to most_pivots.
    """

    k: int = 5
    scale: float = 256.0
    sample: int = 2048
    pivots: int = 32
    most_pivots: int = 512
    annuli: int = 16
    data_block: int = 2048
    key_blocks: int = 8
    query_block: int = 512


def integer_vectors(vectors: DataFrame, vec_id: str, embedding: str, scale: float) -> DataFrame:
    """id and v (floor of scale times each component, as exact doubles) of rows whose vector has only finite components.

    Rows with a null id, a null vector, or a null, NaN or infinite component (also one that
    is infinite only when scaled, beyond 10^305) are left out.
    """
    x = F.transform(F.col(embedding), lambda c: c.cast("double") * F.lit(float(scale)))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & ~F.coalesce(bad, F.lit(True))
    # From 2^52 on a double is an integer, and floor would end at the range of a long.
    whole = lambda c: F.when(F.abs(c) >= float(1 << 52), c).otherwise(F.floor(c).cast("double"))
    return vectors.filter(good).select(F.col(vec_id).cast("long").alias("id"), F.transform(x, whole).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as float64, padded with zeros to dim; exact below 2^53."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(len(sizes), dim).astype(np.float64)
    out = np.zeros((len(sizes), dim))
    at = 0
    for i, n in enumerate(sizes):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


LIMB, LOWEST, HIGHEST = 18, -(1 << 63), (1 << 63) - 1


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """Integers (as doubles) in base 2^LIMB, lowest first; each limb has its number's sign."""
    out = []
    while x.any():
        rest = np.trunc(np.ldexp(x, -LIMB))
        out.append(x - np.ldexp(rest, LIMB))
        x = rest
    return out


def scores(q: np.ndarray, x: np.ndarray, largest: float) -> np.ndarray:
    """Exact integer inner products as longs; those beyond the range of a long are its ends."""
    if largest * largest * max(1, x.shape[1]) < 2.0**53:
        return (q @ x.T).astype(np.int64)
    total = np.zeros((len(q), len(x)), object)
    b = _limbs(x)
    for i, own in enumerate(_limbs(q)):
        for j, other in enumerate(b):
            total += (own @ other.T).astype(np.int64).astype(object) << (LIMB * (i + j))
    return np.minimum(np.maximum(total, LOWEST), HIGHEST).astype(np.int64)


@dataclass(frozen=True)
class Index:
    """Pivots, the common norm, and the range of distances in each annulus: a size bounded by the parameters.

    All but the arguments are in units of unit, the largest component.
    """

    dim: int
    unit: float
    norm2: float
    pivots: np.ndarray
    width: float
    low: np.ndarray
    high: np.ndarray

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        x = x / self.unit
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm2 - (x * x).sum(axis=1), 0))
        return np.column_stack([x, extra])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        d2 = (lifted * lifted).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1)[None, :] - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(d2, 0))

    def cells(self, x: np.ndarray, annuli: int) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(self.lifted(x, query=False))
        pivot = d.argmin(axis=1)
        near = d[np.arange(len(d)), pivot]
        return pivot * annuli + np.minimum((near / self.width).astype(np.int64), annuli - 1), near

    def bounds(self, q: np.ndarray, annuli: int) -> np.ndarray:
        """An upper bound of the score of each query with anything in each annulus; -inf for empty ones."""
        filled = np.isfinite(self.low)
        low, high = np.where(filled, self.low, 0), np.where(filled, self.high, 0)
        d = np.repeat(self.distances(self.lifted(q, query=True)), annuli, axis=1)
        # The margin covers the rounding of distances, whose squares are sums of numbers up to the dimension.
        gap = np.maximum(np.maximum(low - d, d - high) - 1e-6 * (1 + d + self.width * annuli), 0)
        q = q / self.unit
        best = ((q * q).sum(axis=1)[:, None] + self.norm2 - gap * gap) / 2
        return np.where(filled, best + 1e-6 * (np.abs(best) + 1), -np.inf)


def _sample(ints: DataFrame, params: TopKParams) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows that come first by a hash of id and vector."""
    rows = ints.orderBy(F.xxhash64("id", "v"), "id", "v").limit(params.sample).collect()
    dim = max((len(r["v"]) for r in rows), default=0)
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, : len(r["v"])] = r["v"]
    return np.array([r["id"] for r in rows], dtype=np.int64), out


def _far_points(x: np.ndarray, n: int) -> np.ndarray:
    """n rows of x, each as far as can be from those before it."""
    chosen = [0]
    best = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(x)) and best.max() > 0:
        chosen.append(int(best.argmax()))
        best = np.minimum(best, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


#: Keys of one annulus at most, far beyond what any table fills.
KEYS = 1 << 40
PAYLOAD = "cell long, ids binary, vectors binary"
#: Bytes of one message to Spark: beyond 2 GB Arrow has no such column, and a worker holds several.
MESSAGE = 8 << 20
#: Queries whose best scores a task keeps in mind at most.
KEPT_QUERIES = 1 << 17


def packed_type(largest: float) -> np.dtype:
    """The narrowest type that holds the integers from -largest to largest exactly."""
    return np.dtype(next((t for t, most in (("<i1", 127), ("<i2", (1 << 15) - 1), ("<i4", (1 << 31) - 1)) if largest <= most), "<f8"))


def top_k(vectors: DataFrame, is_query: Callable[[Column], Column], params: TopKParams = TopKParams(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query row's k highest scores among the other rows.

    Ties go to the smaller vec_id. A query never meets rows of its own id; of repeated query
    ids the smallest vector asks; repeated other rows are candidates each. Shorter vectors
    count as padded with zeros. With fewer than k candidates all are returned. Vectors with null or
    non-finite components, or without id, take no part. Scores are exact for components of
    any size; a score beyond the range of a long counts, and ranks, as the end of that range.
    An empty table gives an empty one; other columns are not looked at.
    """
    spark = vectors.sparkSession
    ints = materialise(integer_vectors(vectors.select(vec_id, embedding), vec_id, embedding, params.scale), "topk-vectors")
    count, dim, largest = ints.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda c: F.abs(c))))).first()
    dim, largest = int(dim or 0), float(largest or 0)
    unit = largest or 1.0
    norm2 = float(ints.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + (c / unit) * (c / unit)))).first()[0] or 0)
    sample_ids, sample = _sample(ints, params)
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = np.pad(sample, ((0, 0), (0, dim - sample.shape[1])))
    scaled = sample / unit
    lifted = np.column_stack([scaled, np.sqrt(np.maximum(norm2 - (scaled * scaled).sum(axis=1), 0))])
    annuli, n_pivots = params.annuli, min(params.most_pivots, max(params.pivots, math.isqrt(count) // 16))
    draft = Index(dim, unit, norm2, _far_points(lifted, n_pivots), 1.0, np.zeros(1), np.zeros(1))
    # Annuli are as wide as the sample's distances ask; the outermost takes what lies beyond.
    reach = draft.distances(lifted).min(axis=1).max()
    draft = Index(dim, unit, norm2, draft.pivots, max(float(reach), 1e-9) / annuli, np.zeros(1), np.zeros(1))
    draft_b = spark.sparkContext.broadcast(draft)

    def key(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            cell, near = draft_b.value.cells(_matrix(batch.column("v"), dim), annuli) if batch.num_rows else (np.zeros(0, np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell, pa.int32()), pa.array(near)], names=["id", "v", "cell", "near"])

    keyed = materialise(ints.mapInArrow(key, "id long, v array<double>, cell int, near double"), "topk-keyed")
    cells = len(draft.pivots) * annuli
    low, high, keys = np.full(cells, np.inf), np.full(cells, -np.inf), np.ones(cells, np.int64)
    for r in keyed.groupBy("cell").agg(F.min("near").alias("lo"), F.max("near").alias("hi"), F.count("*").alias("n")).collect():  # pivots * annuli rows at most
        low[r["cell"]], high[r["cell"]] = r["lo"], r["hi"]
        keys[r["cell"]] = -(-r["n"] // (params.data_block * params.key_blocks))
    index = Index(dim, unit, norm2, draft.pivots, draft.width, low, high)
    shared = spark.sparkContext.broadcast((index, sample_ids, sample, keys))
    packed = packed_type(largest)

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Sorted rows of annuli to blocks of bounded size."""
        held_cell, ids, vs = None, [], []
        keys = shared.value[3]

        def out() -> list[tuple]:
            # A large annulus has several keys; a block's first row picks one.
            return [(held_cell * KEYS + ids[0] % int(keys[held_cell]), np.array(ids, "<i8").tobytes(), np.concatenate(vs).astype(packed).tobytes())] if ids else []

        for batch in rows:
            x = _matrix(batch.column("v"), dim)
            for i, (cell, own) in enumerate(zip(batch.column("cell").to_pylist(), batch.column("id").to_pylist(), strict=True)):
                if cell != held_cell or len(ids) >= params.data_block:
                    yield from out()
                    held_cell, ids, vs = cell, [], []
                ids.append(own)
                vs.append(x[i])
        yield from out()

    blocks = keyed.repartitionByRange("cell", "near", "id").sortWithinPartitions("cell", "near", "id").mapInArrow(lambda rows: messages(pack(rows)), PAYLOAD)

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Query rows to blocks for each annulus that can still hold one of a query's best."""
        index, known_ids, known, keys = shared.value
        for batch in rows:
            for at in range(0, batch.num_rows, params.query_block):
                part = batch.slice(at, params.query_block)
                ids = part.column("id").to_numpy(zero_copy_only=False)
                q = _matrix(part.column("v"), dim)
                near = scores(q, known, largest)
                own = ids[:, None] == known_ids[None, :]
                threshold = np.full(len(ids), -np.inf)
                for i in range(len(ids)):
                    others = np.sort(near[i][~own[i]])
                    if len(others) >= params.k and others[-params.k] > LOWEST:
                        threshold[i] = float(others[-params.k])
                bound = index.bounds(q, annuli)
                for cell in np.flatnonzero(np.isfinite(index.low)):
                    takes = bound[:, cell] >= threshold / unit / unit
                    if takes.any():
                        # Less what the threshold was rounded by.
                        least = threshold[takes] - 1e-9 * np.where(np.isfinite(threshold[takes]), np.abs(threshold[takes]), 0)
                        load = ids[takes].astype("<i8").tobytes(), least.astype("<f8").tobytes() + q[takes].astype(packed).tobytes()
                        yield from ((int(cell) * KEYS + k, *load) for k in range(int(keys[cell])))

    asked = ints.filter(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v")).mapInArrow(lambda rows: messages(ask(rows)), PAYLOAD)

    def match(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[int]] = {}  # of a query the k highest scores so far, a heap
        for batch in rows:
            columns = [batch.column(c) for c in ("q_ids", "q_vectors", "ids", "vectors")]
            for row in range(batch.num_rows):
                q_ids, q_body, x_ids, x_body = (c[row].as_buffer() for c in columns)
                qi, xi = np.frombuffer(q_ids, "<i8"), np.frombuffer(x_ids, "<i8")
                least = np.frombuffer(q_body, "<f8", len(qi))
                q = np.frombuffer(q_body, packed, len(qi) * dim, 8 * len(qi)).reshape(len(qi), dim).astype(np.float64)
                s = scores(q, np.frombuffer(x_body, packed).reshape(len(xi), dim).astype(np.float64), largest)
                out_q, out_x, out_s = [], [], []
                for i in np.flatnonzero(s.max(axis=1) >= least).tolist():
                    own, kept = int(qi[i]), best.get(int(qi[i]), [])
                    good = np.flatnonzero((s[i] >= least[i]) & (xi != own))
                    if len(kept) == params.k:
                        good = good[s[i, good] >= kept[0]]
                    if len(good) > params.k:
                        good = good[np.lexsort((xi[good], ~s[i, good]))[: params.k]]
                    if not len(good):
                        continue
                    if own not in best and len(best) >= KEPT_QUERIES:
                        best.clear()
                    best[own] = heapq.nlargest(params.k, kept + s[i, good].tolist())[::-1]
                    out_q.append(np.full(len(good), own))
                    out_x.append(xi[good])
                    out_s.append(s[i][good])
                if out_q:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in (out_q, out_x, out_s)], names=["query_id", "vec_id", "score"])

    # Spark takes a payload for some hundred bytes, so without the hint it would broadcast the queries' blocks, however many there are.
    pairs = asked.select("cell", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")).hint("merge").join(blocks.select("cell", "ids", "vectors").hint("merge"), "cell")
    found = pairs.select("q_ids", "q_vectors", "ids", "vectors").mapInArrow(match, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= params.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def messages(rows: Iterable[tuple], most: int = MESSAGE) -> Iterator[pa.RecordBatch]:
    """Rows of PAYLOAD as batches that end once they hold most bytes."""
    kinds = [pa.int64(), pa.binary(), pa.binary()]
    held: list[tuple] = []
    size = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(kinds)], names=["cell", "ids", "vectors"])

    for row in rows:
        held.append(row)
        size += len(row[1]) + len(row[2])
        if size >= most:
            yield out()
            held, size = [], 0
    if held:
        yield out()
