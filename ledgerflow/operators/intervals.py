"""Balances coded as intervals: one row for each stretch of months in which a balance stays the same.

A month spine has accounts x months rows, most of them a carried balance. Here a row says that the
balance of a key holds from the month ``valid_from`` until before ``valid_to`` (NULL: until further
notice), so rows are bounded by the movements, and a report expands only the months it asks for.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where the interval of a key without movements begins.
ALWAYS = dt.date(1, 1, 1)
MAX_MONTHS = 1_200


def balance_intervals(lines: DataFrame, keys: Sequence[str], date: Column, amount: Column,
                      every: DataFrame | None = None) -> DataFrame:
    """(keys, valid_from, valid_to, balance) of the sums of ``amount`` (exact) by month.

    Months whose movements add up to nothing begin no interval. ``every`` is a relation with the
    keys: each of its rows then has a balance at all times, 0 before the first movement. Lines
    without a date or an amount move nothing.

    Lines are summed per key and month with partial sums in the map tasks, so a hot key reaches
    the window as one row a month: the window is over one key's months, bounded by the calendar.
    """
    m = lines.where(date.isNotNull()).groupBy(*keys, F.trunc(date, "MM").alias("valid_from")).agg(F.sum(amount).alias("_moved"))
    m = m.where(F.col("_moved") != 0)
    if every is not None:
        first = every.select(*keys).distinct().select(*keys, F.lit(str(ALWAYS)).cast("date").alias("valid_from"),
                                                      F.lit(0).cast(m.schema["_moved"].dataType).alias("_moved"))
        m = m.unionByName(first)
    w = Window.partitionBy(*keys).orderBy("valid_from")
    return m.select(*keys, "valid_from", F.lead("valid_from").over(w).alias("valid_to"), F.sum("_moved").over(w).alias("balance"))


def month_of(d: dt.date) -> dt.date:
    return d.replace(day=1)


def balances_at(intervals: DataFrame, months: Sequence[dt.date], month_col: str = "month") -> DataFrame:
    """The balances that hold in the months that are asked for (their first days; any day names its
    month, repeats count once): intervals outside are dropped by their bounds before the rest is
    expanded, row by row and without a join. More than ``MAX_MONTHS`` months raise an error."""
    asked = sorted({month_of(d) for d in months})
    if len(asked) > MAX_MONTHS:
        raise ValueError(f"over {MAX_MONTHS} months")
    keys = [c for c in intervals.columns if c not in ("valid_from", "valid_to", "balance")]
    if not asked:
        return intervals.select(*keys, F.col("valid_from").alias(month_col), "balance").limit(0)
    until = F.coalesce("valid_to", F.lit(dt.date(9999, 12, 31)))
    touched = intervals.where((F.col("valid_from") <= F.lit(asked[-1])) & (until > F.lit(asked[0])))
    inside = F.filter(F.array(*map(F.lit, asked)), lambda m: (m >= F.col("valid_from")) & (m < until))
    return touched.select(*keys, F.explode(inside).alias(month_col), "balance")
