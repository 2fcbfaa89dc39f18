"""Data-quality rules: one violation count per rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLAIM_ID_PATTERN = r"^CLM-\d{8}-[A-Z0-9]{4,}$"


def _counted(name: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")


def unique(name: str, df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return _counted(name, df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))


def holds(name: str, df: DataFrame, condition: Column) -> DataFrame:
    """Rows that break the condition; an unknown outcome breaks it."""
    return _counted(name, df.where(~F.coalesce(condition, F.lit(False))))


def no_collisions(name: str, dim: DataFrame, key: str, natural: str) -> DataFrame:
    """Surrogate keys shared by different natural keys."""
    return _counted(name, dim.groupBy(key).agg(F.min(natural).alias("a"), F.max(natural).alias("b")).where("a <> b"))


def report(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)
