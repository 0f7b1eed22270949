"""Shared column conventions of the report jobs on the test tables.

Entity mapping: orders are invoice / journal-entry headers (status = state, priority =
journal kind or payment term), lineitem rows are their lines (return flag ``R`` = credit
side, others debit), part is the account / product (type = level 1, brand = level 2),
customer and supplier are partners.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerflow.functions.money import dec, net_price

# Spanish labels of the order priorities (journal kinds) on the test tables.
PRIORITY_LABELS = {
    "1-URGENT": "Urgente",
    "2-HIGH": "Alta",
    "3-MEDIUM": "Media",
    "4-NOT SPECIFIED": "Sin especificar",
    "5-LOW": "Baja",
}
# Spanish labels of the order states.
STATUS_LABELS = {"F": "Pagada", "O": "Abierta", "P": "Parcial"}

DATA_START = dt.date(1995, 1, 1)


def decode(c: Column, mapping: dict, default=None) -> Column:
    """CASE decode; unknown codes give ``default`` (NULL unless given)."""
    expr = None
    for k, v in mapping.items():
        expr = (F.when(c == F.lit(k), F.lit(v)) if expr is None
                else expr.when(c == F.lit(k), F.lit(v)))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def sql_decode(col: str, mapping: dict, default: str | None = None) -> str:
    """The same decode as SQL text (for the oracle)."""
    whens = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items())
    tail = f" ELSE '{default}'" if default is not None else ""
    return f"CASE {whens}{tail} END"


def line_amount() -> Column:
    """Exact net line amount ``extendedprice * (1 - discount)`` (scale 4)."""
    return net_price("l_extendedprice", "l_discount")


def signed_amount() -> Column:
    """Debit minus credit of a line: returns (flag R) count as credit."""
    a = dec("l_extendedprice")
    return F.when(F.col("l_returnflag") == "R", -a).otherwise(a)


SQL_LINE_AMOUNT = "CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))"
SQL_SIGNED = ("CASE WHEN l_returnflag = 'R' THEN -CAST(l_extendedprice AS DECIMAL(18,2)) "
              "ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END")
