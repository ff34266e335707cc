"""Every registered query of the library, with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from labspark.plans import biology, catalogs, kernels, lookups, pharma, plate, proteins, sequence

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (plate, pharma, biology, sequence, catalogs, kernels, proteins, lookups)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
