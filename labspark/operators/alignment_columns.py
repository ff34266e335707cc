"""Alignment columns: entropy, position-specific scores and codon usage by grouped counts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labspark.functions.sequence import amino_acid, codons


def column_counts(aligned: DataFrame, group: str) -> DataFrame:
    """n of each (group, column, residue); partial counts shrink the residues before the shuffle."""
    letters = aligned.select(group, F.posexplode(F.split("row", "")).alias("column", "residue")).filter("residue <> ''")
    return letters.groupBy(group, "column", "residue").agg(F.count("*").alias("n"))


def column_entropy(aligned: DataFrame, group: str) -> DataFrame:
    """depth and Shannon entropy in bits of each column, from observed frequencies."""
    counts = column_counts(aligned, group)
    whole = counts.withColumn("depth", F.sum("n").over(Window.partitionBy(group, "column")))
    p = F.col("n") / F.col("depth")
    return whole.groupBy(group, "column", "depth").agg((-F.sum(p * F.log2(p))).alias("entropy"))


def pssm(aligned: DataFrame, group: str, background: dict[str, float], pseudocount: float = 0.05) -> DataFrame:
    """Log-odds in bits of each (group, column, residue) against the background, absent residues included."""
    counts = column_counts(aligned, group)
    depth = counts.groupBy(group, "column").agg(F.sum("n").alias("depth"))
    letters = F.explode(F.map_from_arrays(F.array(*(F.lit(k) for k in background)), F.array(*(F.lit(v) for v in background.values())))).alias("residue", "expected")
    full = depth.select(group, "column", "depth", letters).join(counts, [group, "column", "residue"], "left")
    p = (F.coalesce("n", F.lit(0)) + pseudocount) / (F.col("depth") + pseudocount * len(background))
    return full.select(group, "column", "residue", F.log2(p / F.col("expected")).alias("score"))


#: The letters of codons that may have an amino acid, by their numbers; any other is OTHER.
_LETTERS = "ACGTURYSWKMBDHVN"
OTHER = len(_LETTERS)
_NUMBER = np.full(256, OTHER, np.int64)
_NUMBER[[ord(c) for c in _LETTERS]] = range(OTHER)
#: What a codon doesn't run across, as a point of a regular expression doesn't.
_LINE_END = re.compile("[\n\r\x85\u2028\u2029]")


def codon_counts(sequences: DataFrame) -> DataFrame:
    """codon and n, partial sums by task, of the codons of letters for sets of bases: counted in Arrow batches, never rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((OTHER + 1) ** 3, np.int64)
        for batch in batches:
            for seq in batch.column("seq"):
                for line in _LINE_END.split(seq.as_py() or ""):
                    if whole := len(line) // 3 * 3:
                        own = _NUMBER[np.frombuffer(line[:whole].encode("ascii", "replace"), np.uint8)]
                        total += np.bincount((own[::3] * (OTHER + 1) + own[1::3]) * (OTHER + 1) + own[2::3], minlength=len(total))
        found = [i for i in np.flatnonzero(total).tolist() if OTHER not in _digits(i)]
        yield pa.RecordBatch.from_arrays([pa.array(["".join(_LETTERS[k] for k in _digits(i)) for i in found], pa.string()), pa.array(total[found], pa.int64())], names=["codon", "n"])

    return sequences.select("seq").mapInArrow(count, "codon string, n long")


def _digits(i: int) -> tuple[int, int, int]:
    return i // (OTHER + 1) ** 2, i // (OTHER + 1) % (OTHER + 1), i % (OTHER + 1)


def codon_usage(sequences: DataFrame) -> DataFrame:
    """n and weight (share of the commonest codon of its amino acid) of each codon over all sequences."""
    counts = codon_counts(sequences).groupBy("codon").agg(F.sum("n").alias("n")).withColumn("aa", amino_acid(F.col("codon"))).filter("aa IS NOT NULL")
    return counts.withColumn("weight", F.col("n") / F.max("n").over(Window.partitionBy("aa")))


def cai(sequences: DataFrame, usage: DataFrame, key: str) -> DataFrame:
    """Codon adaptation index: the geometric mean of weights, without M, W and stops; usage has 64 rows at most."""
    weights = usage.filter("aa NOT IN ('M', 'W', '*') AND weight > 0").select("codon", F.ln("weight").alias("log_weight"))
    rows = sequences.select(key, F.explode(codons(F.col("seq"))).alias("codon")).groupBy(key, "codon").agg(F.count("*").alias("n"))
    found = rows.join(F.broadcast(weights), "codon")
    return found.groupBy(key).agg(F.sum("n").alias("n_codons"), F.exp(F.sum(F.col("log_weight") * F.col("n")) / F.sum("n")).alias("cai"))


def identities(pairs: DataFrame, key: str) -> DataFrame:
    """pairs (key, query and homolog as aligned rows) with identity: percent of equal residues among columns where both have one."""
    columns = F.arrays_zip(F.split("query", "").alias("q"), F.split("homolog", "").alias("h"))
    both = F.filter(columns, lambda c: c["q"].rlike("^[^-]$") & c["h"].rlike("^[^-]$"))
    same = F.size(F.filter(both, lambda c: c["q"] == c["h"]))
    return pairs.select(key, "query", "homolog", F.coalesce(100.0 * same / F.nullif(F.size(both), F.lit(0)), F.lit(0.0)).alias("identity"))


def homolog_identity(pairs: DataFrame, key: str) -> DataFrame:
    """n, median, least and greatest identity of the homologs of each query."""
    return identities(pairs, key).groupBy(key).agg(F.count("*").alias("n"), F.percentile("identity", F.lit(0.5)).alias("median"), F.min("identity").alias("least"), F.max("identity").alias("greatest"))
