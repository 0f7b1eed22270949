"""Calendar expressions: period bounds, Spanish month names and long dates, clock shifts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerflow.functions._cols import as_col

# Spanish month names, January to December, as printed in the reports.
MONTHS_ES = [
    "enero", "febrero", "marzo", "abril", "mayo", "junio",
    "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
]
# Capitalised month labels used on chart categories.
MONTH_LABELS_ES = [
    "Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio",
    "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre",
]


def as_date(c) -> Column:
    """Date part of a date or timestamp column (no round trip through text)."""
    return F.to_date(as_col(c))


def prev_month_end(c) -> Column:
    """Last day of the month before ``c``."""
    return F.date_sub(F.trunc(as_date(c), "MM"), 1)


def year_start(c) -> Column:
    """1 January of the year of ``c``."""
    return F.trunc(as_date(c), "YEAR")


def month_name(c, labels=MONTHS_ES) -> Column:
    """Month name from a fixed list (no locale dependency)."""
    return F.element_at(F.array(*[F.lit(m) for m in labels]), F.month(as_col(c)))


def long_date_es(c) -> Column:
    """``DD de <mes> del YYYY`` from one date (day, month and year of the same date)."""
    d = as_date(c)
    return F.concat(F.lpad(F.dayofmonth(d).cast("string"), 2, "0"), F.lit(" de "),
                    month_name(d), F.lit(" del "), F.year(d).cast("string"))


def shift_hours(c, hours: int) -> Column:
    """Timestamp moved by ``hours`` (negative = back), e.g. to a local business day."""
    return as_col(c) + F.make_interval(hours=F.lit(hours))


def business_day(c, hours: int) -> Column:
    """Date of ``c`` after a clock shift of ``hours``."""
    return F.to_date(shift_hours(c, hours))


def days_between(later, earlier) -> Column:
    """Whole days ``later - earlier`` as an integer (not an interval)."""
    return F.datediff(as_date(later), as_date(earlier))
