"""Text helpers: document-number split, key extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerflow.functions._cols import as_col


def docnum_separator(c) -> Column:
    """1-based position of the series/sequence separator, NULL when there is none.

    The separator is the first ``-`` when present, else the second ``/``.
    """
    s = as_col(c)
    dash = F.instr(s, "-")
    first_slash = F.instr(s, "/")
    after_first = F.instr(s.substr(first_slash + 1, F.length(s)), "/")
    second_slash = F.when((first_slash > 0) & (after_first > 0), first_slash + after_first).otherwise(0)
    return F.when(dash > 0, dash).when(second_slash > 0, second_slash)


def split_docnum(c) -> tuple[Column, Column]:
    """Split a document number into (series, sequence).

    ``A-12`` -> (``A``, 12); ``X/2019/0007`` -> (``X/2019``, 7). No separator gives
    (NULL, NULL); a non-numeric tail gives a NULL sequence instead of an error.
    """
    s = as_col(c)
    pos = docnum_separator(s)
    series = F.when(pos.isNotNull(), s.substr(F.lit(1), pos - 1))
    seq = F.when(pos.isNotNull(), s.substr(pos + 1, F.length(s))).try_cast("bigint")
    return series, seq


def key_after(c, start: int) -> Column:
    """Numeric key embedded in text from position ``start`` (1-based) on; NULL if not numeric."""
    s = as_col(c)
    return s.substr(F.lit(start), F.length(s)).try_cast("bigint")
