"""Joins of rows with one row per key that stay parallel when one key is hot.

An aggregate keeps the distribution of its grouping, so a join on the same key takes it as it
is, and adaptive execution, which splits only partitions of plain exchanges, leaves the hot
key's rows in one task. A second join key, computed from the first on both sides, makes both
sides exchange; then the side with the rows is split and the other repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPREAD = "_spread"


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``per_key`` (at most one row per key). The key columns have
    the same names and types on both sides; null keys meet nothing, as in SQL."""
    second = F.pmod(F.xxhash64(*keys), F.lit(1024))
    return (rows.withColumn(SPREAD, second).join(per_key.withColumn(SPREAD, second), [*keys, SPREAD], how).drop(SPREAD))
