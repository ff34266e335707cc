"""Workflows: a graph of steps that make DataFrames, with content keys, a Parquet cache and parallel runs."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from labspark.kernels.chem import fnv1a
from labspark.session import shared_dir

Step = Callable[[SparkSession, dict[str, DataFrame]], DataFrame]


@dataclass(frozen=True)
class Node:
    """A step: its key covers module, version, parameters and the keys of what it depends on."""

    id: str
    make: Step
    depends: tuple[str, ...] = ()
    module: str = ""
    version: str = "1"
    params: str = ""


@dataclass
class Result:
    status: str  # done, cached, failed, skipped or cancelled
    key: str
    path: str | None = None
    error: str | None = None


@dataclass
class Dag:
    nodes: list[Node] = field(default_factory=list)

    def validate(self) -> None:
        ids = [n.id for n in self.nodes]
        if any(not i for i in ids):
            raise ValueError("a node has no id")
        if len(set(ids)) < len(ids):
            raise ValueError("two nodes have one id")
        for n in self.nodes:
            for d in n.depends:
                if d == n.id or d not in ids:
                    raise ValueError(f"{n.id!r} depends on {d!r}, which is {'itself' if d == n.id else 'missing'}")
        if len(self.order()) < len(ids):
            raise ValueError("the graph has a cycle")

    def order(self) -> list[str]:
        """Ids with dependencies first; of those that are ready the smallest goes first."""
        left = {n.id: set(n.depends) for n in self.nodes}
        ready = [i for i, d in left.items() if not d]
        heapq.heapify(ready)
        out = []
        while ready:
            now = heapq.heappop(ready)
            out.append(now)
            for i, d in left.items():
                if now in d:
                    d.discard(now)
                    if not d:
                        heapq.heappush(ready, i)
        return out

    def keys(self) -> dict[str, str]:
        by, out = {n.id: n for n in self.nodes}, {}
        for i in self.order():
            n = by[i]
            text = "\x1f".join([n.module, n.version, n.params, *sorted(f"{d}={out[d]}" for d in n.depends)])
            out[i] = f"{fnv1a(text):016x}"
        return out

    def run(self, spark: SparkSession, cache: str | None = None, workers: int = 4, cancelled: Callable[[], bool] = lambda: False) -> dict[str, Result]:
        """Runs ready steps side by side; each is written under its key, and found there by later runs.

        What follows a failed step is skipped; after a cancellation nothing new starts.
        """
        self.validate()
        folder = (cache or f"{shared_dir(spark).rstrip('/')}/flow").rstrip("/")
        by, keys = {n.id: n for n in self.nodes}, self.keys()
        results: dict[str, Result] = {}
        running: dict[Future, str] = {}

        def work(n: Node) -> Result:
            path = f"{folder}/{n.id}-{keys[n.id]}"
            there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
            if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
                return Result("cached", keys[n.id], path)
            try:
                inputs = {d: spark.read.parquet(results[d].path) for d in n.depends}
                n.make(spark, inputs).write.mode("overwrite").parquet(path)
                return Result("done", keys[n.id], path)
            except Exception as e:  # a step's failure is its result
                return Result("failed", keys[n.id], error=f"{type(e).__name__}: {e}")

        with ThreadPoolExecutor(workers) as pool:
            while len(results) < len(self.nodes):
                for i in self.order():
                    if i in results or i in running.values():
                        continue
                    states = [results[d].status if d in results else None for d in by[i].depends]
                    if any(s in ("failed", "skipped", "cancelled") for s in states):
                        results[i] = Result("skipped", keys[i])
                    elif all(s in ("done", "cached") for s in states):
                        if cancelled():
                            results[i] = Result("cancelled", keys[i])
                        else:
                            running[pool.submit(work, by[i])] = i
                if running:
                    finished, _ = wait(running, return_when=FIRST_COMPLETED)
                    for f in finished:
                        results[running.pop(f)] = f.result()
        return results
