"""Ledger balances: the month spine."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators.totals import cross_scalar


def month_spine(keys: DataFrame, dates: DataFrame, start: dt.date | None = None, end: dt.date | None = None,
                month_col: str = "month") -> DataFrame:
    """Every key row x every month start in [start, end]; a bound that is not given is the
    first or last month of ``dates`` (one date column), so no movement falls outside.

    Generated per key row with ``explode(sequence(...))`` — a narrow operation, no join,
    so the spine is produced where the keys already are. No dates, or an end before the
    start: no months.
    """
    d = F.col(dates.columns[0])
    span = dates.agg(F.min(d).alias("_from"), F.max(d).alias("_to"))
    lo = F.trunc(F.lit(start).cast("date") if start else F.col("_from"), "MM")
    hi = F.trunc(F.lit(end).cast("date") if end else F.col("_to"), "MM")
    months = F.when(lo <= hi, F.sequence(lo, hi, F.expr("interval 1 month")))
    rows = keys if start and end else cross_scalar(keys, span)
    return rows.withColumn(month_col, F.explode(months)).select(*keys.columns, month_col)
