"""Pathway enrichment: overlap counts, the hypergeometric upper tail and Benjamini-Hochberg."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_EXACT = [math.lgamma(n + 1) for n in range(16)]


def log_factorial(n: Column) -> Column:
    """ln n!: a short table, then Stirling's series, which is good to 1e-13 from there on."""
    x = n.cast("double")
    far = x * F.ln(x) - x + 0.5 * F.ln(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < len(_EXACT), F.get(F.array(*(F.lit(v) for v in _EXACT)), n.cast("int"))).otherwise(far)


def _log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def upper_tail(k: Column, drawn: Column, marked: Column, total: Column) -> Column:
    """P(overlap >= k): 1 for k <= 0, 0 beyond what is possible, clipped to [0, 1]."""
    top = F.least(drawn, marked)
    low = F.greatest(k, drawn + marked - total)
    term = lambda i: F.exp(_log_choose(marked, i) + _log_choose(total - marked, drawn - i) - _log_choose(total, drawn))
    tail = F.aggregate(F.sequence(low, F.greatest(top, low)), F.lit(0.0), lambda acc, i: acc + term(i))
    return F.when(k <= 0, 1.0).when(k > top, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail)))


def overlaps(sets: DataFrame, query: DataFrame, background: DataFrame, min_size: int = 3) -> DataFrame:
    """pathway, size (within the background), overlap, drawn and universe; small and disjoint sets are left out.

    Members are matched by equal joins with partial counts; drawn and universe are one row.
    """
    inside = query.select("member").distinct().join(background, "member", "left_semi").withColumn("hit", F.lit(1))
    counts = sets.join(background, "member", "left_semi").join(inside, "member", "left").groupBy("pathway").agg(F.count("*").alias("size"), F.count("hit").alias("overlap"))
    universe = background.select("member").distinct().join(inside, "member", "left").agg(F.count("*").alias("universe"), F.count("hit").alias("drawn"))
    return counts.filter((F.col("size") >= min_size) & (F.col("overlap") > 0)).crossJoin(F.broadcast(universe))


def benjamini_hochberg(rows: DataFrame, p: str = "p", order: str = "pathway") -> DataFrame:
    """rows with q: the running minimum of p * m / rank from the largest p down, at most 1.

    Equal p share the largest rank. The table of tests is one window; it has a row a test.
    """
    whole = Window.partitionBy()
    ranked = rows.withColumn("m", F.count("*").over(whole)).withColumn("rank", F.count("*").over(Window.orderBy(p).rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    down = Window.orderBy(F.col(p).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("m") / F.col("rank")).over(down))).drop("m", "rank")


def enrich(sets: DataFrame, query: DataFrame, background: DataFrame, min_size: int = 3) -> DataFrame:
    """overlaps with fold, p and q over the pathways tested."""
    rows = overlaps(sets, query, background, min_size)
    rows = rows.withColumn("fold", F.col("overlap") * F.col("universe") / (F.col("drawn") * F.col("size")))
    return benjamini_hochberg(rows.withColumn("p", upper_tail(F.col("overlap"), F.col("drawn"), F.col("size"), F.col("universe"))))
