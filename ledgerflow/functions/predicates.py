"""Report predicates built from parameters (decided in Python, pushed to the scan by Catalyst)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerflow.functions._cols import as_col
from ledgerflow.functions.dates import as_date


def in_list(c, values: Sequence | None) -> Column:
    """Collection membership; ``None`` or an empty collection means no filter."""
    if not values:
        return F.lit(True)
    return as_col(c).isin(list(values))


def date_between(c, start, end) -> Column:
    """Inclusive date range on a date or timestamp column."""
    return as_date(c).between(F.lit(start), F.lit(end))


def one_of(id_col, id_value, name_col, name_value) -> Column:
    """The id predicate when an id is given and non-zero, else the name predicate."""
    if id_value:
        return as_col(id_col) == F.lit(id_value)
    return as_col(name_col) == F.lit(name_value)


def in_periods(c, periods: Sequence[int] | None) -> Column:
    """(``None`` or empty: no filter.) Membership of ``YYYYMM`` periods, plus the enclosing date range as a plain comparison
    on the column, which the scan can push down (and a date-partitioned table can prune)."""
    if not periods:
        return F.lit(True)
    col = as_col(c)
    lo, hi = min(periods), max(periods)
    start = dt.date(lo // 100, lo % 100, 1)
    end = dt.date(hi // 100 + (hi % 100) // 12, (hi % 100) % 12 + 1, 1)
    exact = (F.year(col) * 100 + F.month(col)).isin(list(periods))
    return (col >= F.lit(start)) & (col < F.lit(end)) & exact


def in_years(c, years: Sequence[int] | None) -> Column:
    """(``None`` or empty: no filter.) Membership of years, plus the enclosing date range the scan can push down."""
    if not years:
        return F.lit(True)
    col = as_col(c)
    start, end = dt.date(min(years), 1, 1), dt.date(max(years) + 1, 1, 1)
    return (col >= F.lit(start)) & (col < F.lit(end)) & F.year(col).isin(list(years))
