"""Deterministic views that read the driver tables as laboratory tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark.tables import spread_table, table


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """df with the named columns rounded (and no negative zeros), so that engines agree on the last digits."""
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in columns})


def wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as wells: supplier = plate, line number = role, quantity = concentration step."""
    line = F.col("l_linenumber")
    readout = 10 * F.col("l_discount") + 10 * F.col("l_tax") + F.col("l_quantity") / 50 + F.when(line == 1, F.lit(100.0)).otherwise(F.lit(0.0))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("plate"), (F.col("l_partkey") % 8).cast("int").alias("row"), (F.col("l_orderkey") % 12).cast("int").alias("col"),
        F.when(line == 1, "positive").when(line == 2, "negative").when(line == 3, "blank").otherwise("sample").alias("role"),
        readout.alias("value"), F.pow(F.lit(10.0), -(F.col("l_quantity") % 10)).alias("conc"), (F.col("l_returnflag") == "R").alias("excluded"),
        F.col("l_orderkey").alias("well_order"), line.alias("well_line"),
    )


WELLS = """wells AS (
  SELECT l_suppkey AS plate, CAST(l_partkey % 8 AS INTEGER) AS row, CAST(l_orderkey % 12 AS INTEGER) AS col,
    CASE l_linenumber WHEN 1 THEN 'positive' WHEN 2 THEN 'negative' WHEN 3 THEN 'blank' ELSE 'sample' END AS role,
    10 * l_discount + 10 * l_tax + l_quantity / 50 + CASE WHEN l_linenumber = 1 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS value,
    pow(10.0::DOUBLE, -(l_quantity % 10)) AS conc, l_returnflag = 'R' AS excluded, l_orderkey AS well_order, l_linenumber AS well_line
  FROM lineitem)"""


def concentrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as concentration series: user = subject, hours since 2024 = t, value = c (the largest at each t)."""
    hours = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01', ts)") / F.lit(3.6e9)
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("subject"), hours.alias("t")).agg(F.max("value").alias("c"))


CONC = """conc AS (
  SELECT user_id AS subject, (epoch_us(ts) - 1704067200000000) / 3.6e9::DOUBLE AS t, max(value) AS c FROM events GROUP BY 1, 2)"""


def gene_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, query, background): a supplier's parts, small parts, and all parts that were ordered."""
    items = table(spark, sf_dir, "lineitem")
    sets = items.select(F.col("l_suppkey").alias("pathway"), F.col("l_partkey").alias("member")).distinct()
    query = table(spark, sf_dir, "part").filter("p_size <= 5").select(F.col("p_partkey").alias("member"))
    return sets, query, items.select(F.col("l_partkey").alias("member")).distinct()


GENES = """sets AS (SELECT DISTINCT l_suppkey AS pathway, l_partkey AS member FROM lineitem),
query AS (SELECT p_partkey AS member FROM part WHERE p_size <= 5),
background AS (SELECT DISTINCT l_partkey AS member FROM lineitem)"""

ALPHABET = "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGTACGTACGTACGTACGTACGTAC"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as DNA: the letters a to z of the whole text stand for bases."""
    letters = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]", "")
    return spread_table(spark, sf_dir, "documents", "doc_id", "lang", "text").select("doc_id", "lang", F.translate(letters, ALPHABET, BASES).alias("seq"))


SEQS = f"""seqs AS (
  SELECT doc_id, lang, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), '{ALPHABET}', '{BASES}') AS seq FROM documents)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as atoms: the first three components are coordinates, the label the chain."""
    x = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("atom"), F.col("label").alias("chain"), x(0).alias("x"), x(1).alias("y"), x(2).alias("z"))


POINTS = """points AS (
  SELECT vec_id AS atom, label AS chain, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"""


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as graph nodes: an edge from a customer's nation to its supplier's, weighed by line items."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    nation = lambda name, key, k: table(spark, sf_dir, name).select(F.col(key), F.col(k))
    joined = items.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    joined = joined.join(nation("customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(nation("supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy(F.col("c_nationkey").alias("source"), F.col("s_nationkey").alias("target")).agg(F.count("*").alias("weight"))


EDGES = """edges AS (
  SELECT c_nationkey AS source, s_nationkey AS target, count(*) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY 1, 2)"""
