"""Fingerprint similarity by an inverted-index join on bits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tanimoto_top_k(queries: DataFrame, library: DataFrame, k: int = 8) -> DataFrame:
    """query_id, id, tanimoto and rank of each query's k best library entries other than itself.

    Both sides are (id, bit) rows without repeats. Only pairs that share a bit are met;
    partial counts shrink them before the shuffle. Ties go to the smaller id.
    """
    sizes = library.groupBy("id").agg(F.count("*").alias("size"))
    own = queries.groupBy("id").agg(F.count("*").alias("query_size")).withColumnRenamed("id", "query_id")
    pairs = queries.select(F.col("id").alias("query_id"), "bit").join(library, "bit").filter("query_id <> id").groupBy("query_id", "id").agg(F.count("*").alias("both"))
    scored = pairs.join(sizes, "id").join(own, "query_id").withColumn("tanimoto", F.col("both") / (F.col("size") + F.col("query_size") - F.col("both")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("tanimoto").desc(), "id"))
    return scored.select("query_id", "id", "tanimoto", rank.alias("rank")).filter(F.col("rank") <= k)


def tanimoto(a: str, b: str):
    """Tanimoto of two sorted bit arrays as a column; two empty ones agree fully."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / either)
