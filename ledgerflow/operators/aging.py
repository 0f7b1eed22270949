"""Receivables ageing: open amounts placed in day buckets by age at ``as_of``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The day buckets of the receivables report, inclusive bounds.
AGE_BUCKETS = [
    ("d0_2", 0, 2),
    ("d3_5", 3, 5),
    ("d6_8", 6, 8),
    ("d9_10", 9, 10),
    ("d11_plus", 11, None),
]


def bucket_columns(age: Column, amount: Column,
                   buckets: Sequence[tuple[str, int, int | None]] = AGE_BUCKETS) -> list[Column]:
    """One column per bucket: ``amount`` when ``age`` falls into it, else 0."""
    cols = []
    for name, lo, hi in buckets:
        inside = age >= lo if hi is None else age.between(lo, hi)
        cols.append(F.when(inside, amount).otherwise(F.lit(0).cast("decimal(18,2)")).alias(name))
    return cols
