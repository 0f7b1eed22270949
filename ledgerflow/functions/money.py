"""Money arithmetic.

Amounts enter as ``decimal(18,2)`` so sums are exact and the order in which partial
aggregates combine cannot change a result; they leave as ``double`` rounded to a fixed
number of digits. Ratios are taken in double (one IEEE division is the same everywhere)
and guarded against a zero divisor.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerflow.functions._cols import as_col


def dec(c, scale: int = 2, precision: int = 18) -> Column:
    """Cast to an exact decimal (default ``decimal(18,2)``)."""
    return as_col(c).cast(f"decimal({precision},{scale})")


def out(c, digits: int = 2) -> Column:
    """Round half away from zero, then hand out as double."""
    return F.round(as_col(c), digits).cast("double")


def ratio(num, den, digits: int | None = 4) -> Column:
    """``num / den`` in double; NULL when the divisor is 0 or NULL (never an error)."""
    r = F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))
    return F.round(r, digits) if digits is not None else r


def gross_up(c, rate: str = "0.12", digits: int = 3) -> Column:
    """Amount plus tax at ``rate``: ``x * rate + x`` rounded to ``digits`` (decimal)."""
    x = dec(c)
    return F.round(x * F.lit(rate).cast("decimal(6,4)") + x, digits)


def net_price(price, discount) -> Column:
    """Exact ``price * (1 - discount)`` for two-decimal inputs (scale 4)."""
    return dec(price) * (F.lit(1).cast("decimal(3,2)") - dec(discount))
