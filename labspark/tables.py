"""Reading the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under sf_dir, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for work that is heavy by row: one that is read in fewer parts than there are cores is dealt anew.

    Large tables have parts enough and are left as they are read, without a shuffle.
    """
    df = table(spark, sf_dir, name)
    df = df.select(*columns) if columns else df
    cores = spark.sparkContext.defaultParallelism
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(2 * cores) if parts < cores else df
