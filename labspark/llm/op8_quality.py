"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A bounded, documented sample of labelled texts is turned into log counts of hashed byte
trigrams and bigrams, weighted by inverse document frequency in the sample, beside the
shares of words and of three-word shingles that repeat, and reduced by a truncated
singular value decomposition. The sample's vectors, their labels and the
projection are broadcast: their size depends on the parameters alone. Every document is
then projected, exact cosine products against all labelled vectors are taken in blocks,
and its nearest neighbours vote with their similarity as weight.

Scores need no shuffle: the one pass over the documents is a map.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labspark.llm._text import batches, buffers, packed, shingles, unpacked, words


@dataclass(frozen=True)
class QualityParams:
    """per_label bounds the sample: so many labelled rows of each label at most."""

    per_label: int = 1024
    buckets: int = 2048
    dims: int = 64
    neighbours: int = 15
    block: int = 1024


class QualityModel:
    """Labelled unit vectors, labels, and what turns a text into such a vector."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray, params: QualityParams, prior: float) -> None:
        self.idf, self.basis, self.vectors, self.labels, self.params, self.prior = idf, basis, vectors, labels, params, prior

    def project(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_weighted(counts, self.idf) @ self.basis)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors.

        All that are as near as the last of them vote, so ties don't depend on any order.
        """
        if len(self.labels) == 0:
            return np.full(len(counts), self.prior)
        got = np.empty(len(counts))
        k = min(self.params.neighbours, len(self.labels))
        for at in range(0, len(counts), self.params.block):
            near = self.project(counts[at : at + self.params.block]) @ self.vectors.T
            last = np.partition(near, len(self.labels) - k, axis=1)[:, len(self.labels) - k, None]
            weight = np.where(near >= last - _TIE, np.maximum(near, 0.0), 0.0).astype(np.float64)
            total = weight.sum(axis=1)
            vote = weight @ self.labels
            got[at : at + len(near)] = np.where(total > 0, vote / np.where(total > 0, total, 1), self.prior)
        return np.clip(got, 0.0, 1.0)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    n = len(idf)
    return np.hstack([_unit(np.log1p(counts[:, :n]) * idf), counts[:, n:]])


#: Cosines this close are equal: single-precision products differ by less with the cut into blocks.
_TIE = 1e-6

#: Features beside the hashed grams: shares of repeated neighbours and of repeated shingles.
_SHARES = 2


def features(column: pa.Array, buckets: int) -> np.ndarray:
    """Counts of hashed byte bigrams and trigrams of whole texts and two shares of repeats, a row each.

    A null has none. The first share is that of words equal to the word before them, the
    second that of three-word shingles that occurred earlier in the text.
    """
    data, offsets = buffers(column)
    out = np.zeros((len(offsets) - 1, buckets + _SHARES), np.float32)
    for i, own in enumerate(words(column)):
        h = own.hashes
        if len(h) > 3:
            s = shingles(h, 3)
            out[i, buckets] = np.count_nonzero(h[1:] == h[:-1]) / (len(h) - 1)
            out[i, buckets + 1] = 1 - len(np.unique(s)) / len(s)
        # Long texts are counted in parts that overlap by the gram length less one.
        for at in range(int(offsets[i]), int(offsets[i + 1]), 1 << 20):
            x = data[at : min(at + (1 << 20) + 2, int(offsets[i + 1]))].astype(np.uint32)
            two = x[:-1][: 1 << 20] * np.uint32(257) + x[1:][: 1 << 20]
            three = x[:-2] * np.uint32(66049) + x[1:-1] * np.uint32(257) + x[2:]
            for grams, salt in ((two, 0x9E3779B1), (three, 0x85EBCA6B)):
                out[i, :buckets] += np.bincount((grams * np.uint32(salt)) >> np.uint32(32 - (buckets.bit_length() - 1)), minlength=buckets)
    return out


def fit(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> QualityModel:
    """Fit on labelled documents; rows with a null id or label, or without a document, take no part.

    The sample is the per_label rows of each label that come first by a hash of the id, so
    that reruns agree and no order of the rows matters. Repeated label rows count once.
    """
    ranked = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = None
    for label in (0, 1):
        part = ranked.filter(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.per_label)
        chosen = part if chosen is None else chosen.unionByName(part)
    ids = {r["doc_id"]: r["quality"] for r in chosen.collect()}  # at most 2 * per_label rows
    nothing = QualityModel(np.ones(params.buckets, np.float32), np.zeros((params.buckets + _SHARES, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), params, 0.5)
    if not ids:
        return nothing
    buckets = params.buckets
    wanted = docs.select("doc_id", "text").filter(F.col("doc_id").isin(list(ids)))

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            got = features(batch.column("text"), buckets)
            packed = [row.astype("<f4").tobytes() for row in got]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "counts"])

    seen: dict[int, bytes] = {}
    for row in wanted.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, counts binary").dropDuplicates(["doc_id", "counts"]).toLocalIterator():
        key, value = row["doc_id"], bytes(row["counts"])
        if key not in seen or value < seen[key]:  # one row of a repeated id, whatever the order
            seen[key] = value
    order = sorted(seen)
    if not order:
        return nothing
    y = np.array([ids[k] for k in order], dtype=np.float64)
    x = np.frombuffer(b"".join(seen[k] for k in order), "<f4").reshape(len(order), buckets + _SHARES)
    idf = (np.log((1 + len(x)) / (1 + (x[:, :buckets] > 0).sum(axis=0))) + 1).astype(np.float32)
    z = _weighted(x, idf)
    rng = np.random.default_rng(7)
    dims = max(1, min(params.dims, min(z.shape)))
    sketch = z.T @ (z @ rng.standard_normal((z.shape[1], dims + 16)).astype(np.float32))
    for _ in range(4):
        q, _ = np.linalg.qr(sketch)
        sketch = z.T @ (z @ q)
    q, _ = np.linalg.qr(sketch)
    _, _, vt = np.linalg.svd(z @ q, full_matrices=False)
    basis = (q @ vt.T)[:, :dims].astype(np.float32)
    return QualityModel(idf, basis, _unit(z @ basis).astype(np.float32), y, params, float(y.mean()))


def classify(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) added; a null text counts as empty.

    A text without features, or without a labelled neighbour of positive similarity, gets
    the sample's share of label 1. A column named score in docs is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != "score"]
    schema = docs.select(*kept).schema.add("score", "double")

    def score(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches(rows):
            got = model.score(features(batch.column("text"), model.params.buckets)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*batch.schema.names, "score"])

    return docs.select(*kept).mapInArrow(score, schema)


def held_out(doc_id: str = "doc_id"):
    """True where a row's label is kept for testing: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def accepted(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of docs with a score of one half or more, with their own columns."""
    return unpacked(classify(packed(docs), model).filter(F.col("score") >= 0.5), docs.columns)


def quality(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs, learnt from the other folds alone.

    Null text: scored as empty. Repeated rows: each gets its row. No labels: all score 0.5.
    A null doc_id is not held out.
    """
    model = fit(docs, labels.filter(~held_out()), params)
    scored = classify(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
