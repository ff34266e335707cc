"""Nucleic acid design: guide sites, off-targets by a pigeonhole join, forbidden patterns, spliced features."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.functions.sequence import reverse_complement, reverse_complement_text

GUIDE = 20


def guide_sites(sequences: DataFrame, key: str, seq: str) -> DataFrame:
    """key, strand, position (0-based, on the forward strand) and site of each 20-mer before an NGG motif, on both strands.

    Sites of other letters than ACGT are left out; a null or short sequence has none. Texts
    are scanned in Arrow batches, each strand once, as a native substring would walk a long
    text from its start for every place.
    """
    rule = re.compile(f"(?=([ACGT]{{{GUIDE}}})[A-Z]GG)")

    @F.pandas_udf("array<struct<strand: string, position: int, site: string>>")
    def scan(texts: pd.Series) -> pd.Series:
        found = []
        for text in texts:
            forward = (text or "").upper()
            back, n = reverse_complement_text(forward), len(forward)
            own = [{"strand": "+", "position": m.start(), "site": m[1]} for m in rule.finditer(forward)]
            found.append(own + [{"strand": "-", "position": n - m.start() - GUIDE, "site": m[1]} for m in rule.finditer(back)])
        return pd.Series(found)

    return sequences.select(key, F.explode(scan(F.col(seq))).alias("h")).select(key, "h.*")


def mismatches(a: Column, b: Column) -> Column:
    """Places at which two texts of a length differ."""
    return F.size(F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))))


def off_targets(guides: DataFrame, sites: DataFrame, most: int = 2) -> DataFrame:
    """guides (guide_id, guide) with the columns of sites (site and others) at most so many mismatches away, and mismatches.

    A guide and a site that differ in most places or fewer agree in one of most + 1 blocks:
    an equal join on (block number, block) meets every such pair, and the first block on
    which a pair agrees reports it, so that none is reported twice.
    """
    cuts = [GUIDE * k // (most + 1) for k in range(most + 2)]
    block = lambda c, k: F.substring(F.col(c), cuts[k] + 1, cuts[k + 1] - cuts[k])
    spread = lambda df, c: df.select("*", F.posexplode(F.array(*(block(c, k) for k in range(most + 1)))).alias("block_no", "block"))
    both = spread(guides.filter(F.length("guide") == GUIDE), "guide").join(spread(sites.filter(F.length("site") == GUIDE), "site"), ["block_no", "block"])
    earlier = F.lit(False)
    for k in range(most):
        earlier = earlier | ((F.col("block_no") > k) & (block("guide", k) == block("site", k)))
    return both.filter(~earlier).withColumn("mismatches", mismatches(F.col("guide"), F.col("site"))).filter(F.col("mismatches") <= most).drop("block_no", "block")


def forbidden(seq: Column, patterns: tuple[str, ...], longest_run: int) -> Column:
    """The patterns found on either strand, and run:N for a run of one letter longer than longest_run."""
    back = reverse_complement(seq)
    found = [F.when(F.contains(seq, F.lit(p)) | F.contains(back, F.lit(p)), F.lit(p)) for p in patterns]
    run = F.array_max(F.transform(F.regexp_extract_all(seq, F.lit("A+|C+|G+|T+"), 0), lambda r: F.length(r)))
    return F.array_compact(F.array(*found, F.when(run > longest_run, F.concat(F.lit("run:"), run))))


def feature_sequence(seq: Column, parts: Column, reverse: Column) -> Column:
    """The spliced letters of parts (start, end; 0-based, half-open; end before start wraps a circle), turned where reverse."""
    n = F.length(seq)
    piece = lambda p: F.when(p["end"] >= p["start"], F.substr(seq, p["start"] + 1, p["end"] - p["start"])).otherwise(F.concat(F.substr(seq, p["start"] + 1, n), F.substr(seq, F.lit(1), p["end"])))
    joined = F.array_join(F.transform(parts, piece), "")
    return F.when(reverse, reverse_complement(joined)).otherwise(joined)
