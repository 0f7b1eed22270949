"""Master/detail nesting and header/line reconciliation.

The reports open a sub-report per master row (one query per row). Here it is one left
join. Details are returned as flat rows numbered within their master (``detail_no``)
with the master's detail count, so no master — however many lines it has — is gathered
into a single array, task or driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators import scan
from ledgerflow.operators.spread import join_per_key


def master_detail(master: DataFrame, detail: DataFrame, key: str, order: Sequence,
                  no_col: str = "detail_no", count_col: str = "detail_count") -> DataFrame:
    """Every master row with each of its details (or one row of NULLs when it has none).

    ``detail_no`` numbers details per master in ``order`` (a full tie-break);
    ``detail_count`` is the number of details of the master (0 when none).
    """
    detail = detail.join(master.select(key), key, "left_semi")   # only details of listed masters
    d = scan.chunk_by_range(detail, [key], order)
    d = scan.scan_all(d, [key], order, [(no_col, "sum", F.lit(1)), (count_col, "total", F.lit(1))]).drop(scan.CHUNK)
    out = master.join(d, key, "left")
    return out.withColumn(count_col, F.coalesce(F.col(count_col), F.lit(0)).cast("long")) \
              .withColumn(no_col, F.col(no_col).cast("long"))


def reconcile(headers: DataFrame, details: DataFrame, key: str, declared: str, amount: Column,
              summed_col: str = "detail_total", status_col: str = "status",
              ok: str = "Cuadrada", bad: str = "Revisar") -> DataFrame:
    """Declared header amount against the sum of its details.

    Inner join as in the report: headers without details do not appear. Sums are exact
    (decimal), so equality is not disturbed by float noise.
    """
    sums = details.groupBy(key).agg(F.sum(amount).alias(summed_col))
    j = headers.join(sums, key, "inner")
    return j.withColumn(status_col, F.when(F.col(declared) != F.col(summed_col), F.lit(bad))
                                     .otherwise(F.lit(ok)))


def exclusive_rows(df: DataFrame, keys: Sequence[str], other: str) -> DataFrame:
    """Rows for which no other row with the same ``keys`` has a different ``other`` value.

    Same result as ``NOT EXISTS (same keys AND other <> this.other)``: a row stays when its
    ``other`` is NULL (the comparison is never true) or when all non-NULL ``other`` values
    of its key group are equal. Computed as one aggregation per key group (min = max) and
    a join on the keys that splits hot groups — linear in the rows, never comparing the pairs
    of a group.
    """
    groups = df.groupBy(*keys).agg(F.min(other).alias("_omin"), F.max(other).alias("_omax"))
    j = join_per_key(df, groups, keys, "left")       # a NULL key equals no key: such rows find no group and stay
    keep = F.col(other).isNull() | F.col("_omin").isNull() | (F.col("_omin") == F.col("_omax"))
    return j.where(keep).drop("_omin", "_omax")
