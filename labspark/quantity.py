"""Quantities: a value with unit, error, provenance tier and source, as a struct column.

Tiers go measured < predicted < model < heuristic < not_computed; what is derived has the
weakest tier of its inputs. A heuristic carries no unit, and a quantity without its
prerequisite is not computed: its value is NULL and its source names what is missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIERS = ("measured", "predicted", "model", "heuristic", "not_computed")
SCHEMA = "struct<value: double, unit: string, error: double, provenance: string, source: string>"


def quantity(value: Column, unit: str, provenance: str, source: str, error: Column | None = None) -> Column:
    """A quantity; a heuristic with a unit is refused."""
    if provenance not in TIERS:
        raise ValueError(f"no tier {provenance!r}")
    if provenance == "heuristic" and unit:
        raise ValueError("a heuristic carries no unit")
    number = value.cast("double")
    return F.struct(
        number.alias("value"), F.when(number.isNotNull(), F.lit(unit)).alias("unit"), (F.lit(None) if error is None else error).cast("double").alias("error"),
        F.when(number.isNull(), F.lit("not_computed")).otherwise(F.lit(provenance)).alias("provenance"), F.lit(source).alias("source"),
    )


def not_computed(missing: str) -> Column:
    nothing = F.lit(None).cast("double")
    return F.struct(nothing.alias("value"), F.lit(None).cast("string").alias("unit"), nothing.alias("error"), F.lit("not_computed").alias("provenance"), F.lit(missing).alias("source"))


def require(condition: Column, made: Column, missing: str) -> Column:
    """made where the condition holds, else not computed for what is missing."""
    return F.when(F.coalesce(condition, F.lit(False)), made).otherwise(not_computed(missing))


def tier_rank(provenance: Column) -> Column:
    return F.array_position(F.array(*(F.lit(t) for t in TIERS)), provenance)


def weakest(*provenances: Column) -> Column:
    ranks = [tier_rank(p) for p in provenances]
    return F.get(F.array(*(F.lit(t) for t in TIERS)), ((F.greatest(*ranks) if len(ranks) > 1 else ranks[0]) - 1).cast("int"))
