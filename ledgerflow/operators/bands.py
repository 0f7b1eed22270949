"""Report calculations over ordered rows: control breaks, accumulators.

A report group starts a new instance whenever its key differs from the row before, so
with rows not sorted by the key one key can form several groups (runs). ``with_breaks``
numbers these runs. Running values use ``operators.scan`` (skew-safe chunked scans)
unless the caller states that the partition key is small (``plain=True``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.operators import scan


def with_breaks(df: DataFrame, keys: Sequence[str], order: Sequence, by: Sequence[str] = (),
                run_col: str = "run_id", plain: bool = False, keep_chunk: bool = False) -> DataFrame:
    """Add ``run_col``: 1, 2, ... numbering the runs of equal ``keys`` in ``order`` per ``by``.

    ``order`` must be a full tie-break. ``by`` is an outer partition (book, company) that
    the report never crosses; with none, the order is global and the chunked scan keeps it
    parallel.
    """
    key = F.struct(*keys)
    if plain and by:
        w = Window.partitionBy(*by).orderBy(*order)
        prev = F.lag(key).over(w)
        start = (prev.isNull() | (prev != key)).cast("int")
        return (df.withColumn("_start", start)
                  .withColumn(run_col, F.sum("_start").over(
                      w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
                  .drop("_start"))
    d = scan.chunk_by_range(df.withColumn("_key", key), list(by), order)
    d = scan.lag(d, F.col("_key"), list(by), order, "_prevkey")
    d = d.withColumn("_start", (F.col("_prevkey").isNull() | (F.col("_prevkey") != F.col("_key"))).cast("int"))
    d = scan.cumsum(d, F.col("_start"), list(by), order, run_col)
    d = d.drop("_key", "_prevkey", "_start").withColumn(run_col, F.col(run_col).cast("long"))
    return d if keep_chunk else d.drop(scan.CHUNK)


def resettable_running(df: DataFrame, value: str, by: Sequence[str], order: Sequence,
                       opening: Column, out: str = "acc", prev_out: str | None = None,
                       chunked: bool = False) -> DataFrame:
    """Accumulator that restarts at ``opening + x`` whenever the previous movement is 0 or absent.

    ``acc_i = opening + x_i`` if ``coalesce(x_{i-1}, 0) = 0`` else ``acc_{i-1} + x_i``.
    Equivalently ``acc_i = opening + S_i - S_{s-1}`` where ``S`` is the running sum per key
    and ``s`` the last restart at or before ``i``; all three pieces are chunked scans.
    """
    by = list(by)
    d = df if chunked else scan.chunk_by_range(df, by, order)
    d = scan.scan_all(d, by, order, [("_prevx", "lag", F.col(value)), ("_S", "sum", F.col(value))])
    d = d.withColumn("_restart", F.coalesce(F.col("_prevx"), F.lit(0)) == 0)
    d = scan.last_non_null(d, F.when(F.col("_restart"), F.col("_S") - F.col(value)), by, order, "_base")
    d = d.withColumn(out, opening + F.col("_S") - F.col("_base"))
    if prev_out:
        d = d.withColumnRenamed("_prevx", prev_out)
    d = d.drop("_prevx", "_S", "_restart", "_base")
    return d if chunked else d.drop(scan.CHUNK)
