"""Total rows and shares of a total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_total_row(grouped: DataFrame, label_col: str, label: str, totals: DataFrame) -> DataFrame:
    """Append ``totals`` (one row) under ``grouped``, labelled ``label``; columns by name."""
    t = totals.withColumn(label_col, F.lit(label))
    missing = [c for c in grouped.columns if c not in t.columns]
    for c in missing:
        t = t.withColumn(c, F.lit(None).cast(grouped.schema[c].dataType))
    return grouped.unionByName(t.select(*grouped.columns))


def cross_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row as scalar subqueries.

    Spark evaluates each subquery once (identical ones are merged, and the subquery reuses
    the exchanges it shares with ``df``) and inlines the value: no join, no cross product.
    ``one_row`` must produce at most one row (an aggregate without keys, or a filter on a
    unique key); Spark raises an error otherwise.
    """
    packed = one_row.select(F.struct(*one_row.columns).alias("_s")).scalar()     # one subquery
    return df.select("*", *[packed.getField(c).alias(c) for c in one_row.columns])


def share_text(part: Column, total: Column) -> Column:
    """``round(100 * part / total)`` printed as an integer with ``%``; NULL when total is 0."""
    pct = F.round(F.try_divide(F.lit(100.0) * part.cast("double"), total.cast("double")), 0)
    return F.concat(pct.cast("bigint").cast("string"), F.lit("%"))


def stack_metrics(df: DataFrame, keys: Sequence[str], metrics: Sequence[tuple[str, Column]],
                  name_col: str = "metric", value_col: str = "value") -> DataFrame:
    """Turn several metric columns of one row into several (metric, value) rows (UNION ALL of
    parallel branches computed in a single pass)."""
    arr = F.array(*[F.struct(F.lit(n).alias(name_col), c.cast("double").alias(value_col))
                    for n, c in metrics])
    return df.select(*keys, F.inline(arr))
