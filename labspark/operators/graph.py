"""Weighted graphs as edge tables (source, target, weight): degree, components, modularity, betweenness, Louvain."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labspark.operators.components import components

__all__ = ["betweenness", "clean", "components", "degree", "louvain", "modularity"]


def clean(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): self-loops and edges without evidence go, each with a reason."""
    reason = F.when(F.col("source") == F.col("target"), "self-loop").when(F.col("weight").isNull() | (F.col("weight") <= 0), "no evidence")
    marked = edges.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def degree(edges: DataFrame) -> DataFrame:
    """node, degree (edges at either end, repeats counted) and strength (their weights)."""
    ends = edges.select(F.col("source").alias("node"), "weight").unionByName(edges.select(F.col("target").alias("node"), "weight"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, q: the weighted modularity of the labels (node, label) over undirected edges."""
    side = lambda k: labels.select(F.col("node").alias(k), F.col("label").alias(f"{k}_label"))
    rows = edges.join(side("source"), "source").join(side("target"), "target")
    inner = rows.filter("source_label = target_label").groupBy(F.col("source_label").alias("label")).agg(F.sum("weight").alias("inside"))
    ends = degree(edges).join(labels, "node").groupBy("label").agg(F.sum("strength").alias("strength"))
    total = edges.agg(F.sum("weight").cast("double").alias("m"))
    both = ends.join(inner, "label", "left").crossJoin(F.broadcast(total))
    share = F.coalesce("inside", F.lit(0)) / F.col("m") - F.pow(F.col("strength") / (2 * F.col("m")), F.lit(2.0))
    return both.agg(F.sum(share).alias("q"))


def betweenness(edges: DataFrame, max_edges: int = 5_000_000) -> DataFrame:
    """node and betweenness (unweighted shortest paths, halved) over an undirected graph.

    Sources are spread over tasks and each task runs its own searches over the adjacency,
    which is broadcast after its size was checked; a larger graph is refused.
    """
    spark = edges.sparkSession
    pairs = edges.filter("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    if pairs.count() > max_edges:
        raise ValueError(f"betweenness takes at most {max_edges} edges")
    near: dict = {}
    for a, b in pairs.orderBy("a", "b").toLocalIterator():
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    shared = spark.sparkContext.broadcast(near)
    kind = edges.schema["source"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near = shared.value
        for batch in batches:
            total: dict = {}
            for s in batch["node"]:
                order, paths, level, before = [], {s: 1.0}, {s: 0}, {}
                queue = [s]
                for v in queue:
                    order.append(v)
                    for w in near[v]:
                        if w not in level:
                            level[w] = level[v] + 1
                            queue.append(w)
                        if level[w] == level[v] + 1:
                            paths[w] = paths.get(w, 0.0) + paths[v]
                            before.setdefault(w, []).append(v)
                depend = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in before.get(w, ()):
                        depend[v] += paths[v] / paths[w] * (1 + depend[w])
                    if w != s:
                        total[w] = total.get(w, 0.0) + depend[w]
            yield pd.DataFrame({"node": list(total), "part": list(total.values())})

    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    parts = nodes.mapInPandas(run, f"node {kind}, part double")
    return nodes.join(parts.groupBy("node").agg((F.sum("part") / 2).alias("betweenness")), "node", "left").select("node", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def louvain(edges: DataFrame, max_passes: int = 100, max_edges: int = 1_000_000) -> DataFrame:
    """node and label after local moving in ascending node order, as a pass over a graph of checked size.

    The moves depend on their order, so they run in one place; a larger graph is refused.
    """
    spark = edges.sparkSession
    pairs = edges.filter("source <> target").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum("weight").cast("double").alias("w"))
    if pairs.count() > max_edges:
        raise ValueError(f"louvain takes at most {max_edges} edges")
    near: dict = {}
    for a, b, w in pairs.orderBy("a", "b").toLocalIterator():
        near.setdefault(a, {})[b] = w
        near.setdefault(b, {})[a] = w
    label = {v: v for v in near}
    strength = {v: sum(ws.values()) for v, ws in near.items()}
    total, m = dict(strength), sum(strength.values()) / 2
    for _ in range(max_passes):
        moved = False
        for v in sorted(near):
            links: dict = {}
            for u, w in near[v].items():
                links[label[u]] = links.get(label[u], 0.0) + w
            total[label[v]] -= strength[v]
            gain = lambda c: links.get(c, 0.0) - total[c] * strength[v] / (2 * m)  # noqa: B023, E731
            best = max(sorted(links), key=lambda c: (gain(c), c == label[v]))
            if gain(best) <= gain(label[v]) + 1e-12:
                best = label[v]
            moved |= best != label[v]
            label[v] = best
            total[best] += strength[v]
        if not moved:
            break
    kind = edges.schema["source"].dataType.simpleString()
    return spark.createDataFrame(sorted(label.items()), f"node {kind}, label {kind}")


def cycle_rank(atoms: DataFrame, bonds: DataFrame, key: str) -> DataFrame:
    """atoms, bonds, parts and rings (independent cycles: bonds - atoms + parts) of each molecule.

    atoms has key and atom, bonds key, a and b; atoms are known by key and atom together. A
    bond counts once, whichever way round and however often it is given.
    """
    node = lambda c: F.struct(F.col(key), F.col(c).alias("atom"))
    once = bonds.select(key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    joined = components(once.select(node("a").alias("a"), node("b").alias("b")))
    # A component has one more atom than bonds of a spanning tree, so the joined atoms less the components are saved.
    tied = joined.groupBy(F.col(f"node.{key}").alias(key)).agg((F.count("*") - F.countDistinct("component")).alias("tied"))
    sizes = atoms.select(key, "atom").distinct().groupBy(key).agg(F.count("*").alias("atoms"))
    counts = sizes.join(once.groupBy(key).agg(F.count("*").alias("bonds")), key, "left").join(tied, key, "left")
    n, m, t = F.col("atoms"), F.coalesce("bonds", F.lit(0)), F.coalesce("tied", F.lit(0))
    return counts.select(key, "atoms", m.alias("bonds"), (n - t).alias("parts"), (m - t).alias("rings"))
