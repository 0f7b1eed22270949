"""Inline constant relations (``VALUES`` lists): decode tables, bucket lists, control rows.

These are small by construction (their size is the length of a literal list), so joins
against them may always be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.functions.predicates import in_list

MAX_INLINE_ROWS = 10_000


def values(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A literal relation of distinct rows, marked for broadcast: a literal given twice must not
    double the rows that it meets. Refuses lists that are not small."""
    rows = list(dict.fromkeys(map(tuple, rows)))
    if len(rows) > MAX_INLINE_ROWS:
        raise ValueError(f"inline relation of {len(rows)} rows; load it as a table instead")
    return F.broadcast(spark.createDataFrame(rows, schema))


def where_in(df: DataFrame, column: str, members: Sequence | None) -> DataFrame:
    """Rows whose ``column`` is in a parameter list of any length; ``None`` or an empty list means
    no filter, NULLs and repeats in the list change nothing (each row comes out once at most).

    Up to ``MAX_INLINE_ROWS`` distinct values it is a pushed IN list. A longer list becomes a
    relation and a semi-join, with its smallest and largest value pushed to the scan; Spark picks
    the join by the list's size."""
    if not members:
        return df
    found = sorted({m for m in members if m is not None})
    if not found:
        return df.limit(0)
    if len(found) <= MAX_INLINE_ROWS:
        return df.where(in_list(column, found))
    typ = df.schema[column].dataType.simpleString()
    ids = df.sparkSession.createDataFrame([(m,) for m in found], f"_member {typ}")
    bounded = df.where(F.col(column).between(F.lit(found[0]), F.lit(found[-1])))
    return bounded.join(ids, bounded[column] == ids["_member"], "left_semi")
