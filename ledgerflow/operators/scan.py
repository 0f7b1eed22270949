"""Ordered scans (running sums, previous-row values) that stay parallel under skew.

A window ``partitionBy(account).orderBy(date)`` puts every row of one account into one
task; when one account holds a third of all rows that task holds a third of the data.
Here rows are instead range-partitioned on ``(by..., order...)`` into chunks of even size
(a hot key is cut into several chunks), the window runs per ``(chunk, key)``, and the
value a key carries into a chunk from its earlier chunks is read from a summary table
with at most two rows per chunk (only the first and the last key of a chunk can cross a
chunk edge). The summary is bounded by the chunk count, so broadcasting it is safe.

Chunks are pinned by a reliable checkpoint (``spark.checkpoint.dir``): the range bounds
are sampled once, and every later branch reads the same chunk of every row, also when a
lost executor forces a recomputation.

There is one path at every size: the chunk count is ``ledgerflow.scan.chunks``, by default
``spark.sql.shuffle.partitions``, which a cluster sizes for its data anyway. Where the rows are
counted beforehand, it is more if a chunk would have over ``CHUNK_ROWS`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerflow.session import ensure_checkpoint_dir

CHUNK = "_chunk"
CHUNK_ROWS = 500_000        # rows of a chunk, where they are counted
_G = "_scan_all"


def plan_chunks(spark: SparkSession, rows: int = 0) -> int:
    """Number of chunks of an ordered scan; with ``rows`` at least one for each ``CHUNK_ROWS``."""
    least = int(spark.conf.get("ledgerflow.scan.chunks", spark.conf.get("spark.sql.shuffle.partitions")))
    return max(least, -(-rows // CHUNK_ROWS))


def chunk_by_range(df: DataFrame, by: Sequence[str], order: Sequence, num_chunks: int | None = None,
                   checkpoint: bool = True) -> DataFrame:
    """Add ``_chunk``: the range partition of each row on ``(by..., order...)``.

    ``order`` must make rows unique within ``by`` when the result depends on row order
    (``rows`` frames); peers (equal sort values) always land in the same chunk.
    """
    spark = df.sparkSession
    n = num_chunks or plan_chunks(spark)
    sort_cols = [*by, *order]
    out = df.repartitionByRange(n, *sort_cols).withColumn(CHUNK, F.spark_partition_id())
    if checkpoint:
        ensure_checkpoint_dir(spark)
        out = out.checkpoint(eager=True)
    return out


def number_rows(df: DataFrame, order: Sequence[str], out: str, keep: Sequence[str], num_chunks: int | None = None) -> DataFrame:
    """The columns ``keep`` of the rows in ``order``, sorted over the whole frame, with their row
    number (1, 2, ...) as ``out``.

    One exchange: rows are sorted within the chunks, their ids count on within a chunk, and the
    summary (one row a chunk) has the rows of the chunks before.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    d = (df.repartitionByRange(num_chunks or plan_chunks(spark), *order).sortWithinPartitions(*order)
           .select(*keep, F.spark_partition_id().alias(CHUNK), F.monotonically_increasing_id().alias("_id")).checkpoint(eager=True))
    per = d.groupBy(CHUNK).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summary = per.select(CHUNK, (before - F.col("_first") + 1).alias("_add"))
    return d.join(F.broadcast(summary), CHUNK).select(*keep, (F.col("_id") + F.col("_add")).alias(out))


def _key_eq(by: Sequence[str], left: str, right: str):
    conds = [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in by]
    return reduce(lambda a, b: a & b, conds)


def _edge_rows(d: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of ``d`` whose key is the first or the last key of their chunk."""
    k = F.struct(*by)
    edges = d.groupBy(CHUNK).agg(F.min(k).alias("_first"), F.max(k).alias("_last"))
    return (d.join(F.broadcast(edges), CHUNK)
             .where((F.struct(*by) == F.col("_first")) | (F.struct(*by) == F.col("_last")))
             .drop("_first", "_last"))


def _attach(local: DataFrame, summary: DataFrame, by: Sequence[str]) -> DataFrame:
    cond = (F.col(f"l.{CHUNK}") == F.col(f"s.{CHUNK}")) & _key_eq(by, "l", "s")
    s_cols = [c for c in summary.columns if c not in (CHUNK, *by)]
    return (local.alias("l").join(F.broadcast(summary.alias("s")), cond, "left")
                 .select("l.*", *[F.col(f"s.{c}") for c in s_cols]))


def _with_group(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str], bool]:
    if by:
        return df, list(by), False
    return df.withColumn(_G, F.lit(0)), [_G], True


def scan_all(d: DataFrame, by: Sequence[str], order: Sequence, specs: Sequence[tuple]) -> DataFrame:
    """Several ordered scans over one chunked frame in a single pass.

    ``specs``: ``(out, kind, value)`` or ``(out, kind, value, frame)`` with kind
    ``sum`` (running sum; frame ``rows`` or ``range``), ``lag`` (previous row's value),
    ``last`` (most recent non-NULL value up to the row), ``total`` (sum over all rows of the
    key, on each of them) or ``first`` (value of the key's first row, on each of them). One set
    of per-chunk windows, one aggregation over the chunk-edge rows, one window over the
    (bounded) summary and one broadcast join serve all specs. A key that spans chunks is an
    edge key in each of them, so the summary has its whole total, and no row set is joined
    with its own aggregate.
    """
    d, by, added = _with_group(d, by)
    specs = [tuple(s) + (("rows",) if len(s) == 3 else ()) for s in specs]
    for i, (_, _, value, _) in enumerate(specs):
        d = d.withColumn(f"_v{i}", value)
    base = Window.partitionBy(CHUNK, *by).orderBy(*order)
    rows_w = base.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    range_w = base.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole_w = Window.partitionBy(CHUNK, *by)
    local = d
    need_first = False
    for i, (_, kind, _, frame) in enumerate(specs):
        v = F.col(f"_v{i}")
        if kind == "sum":
            local = local.withColumn(f"_l{i}", F.sum(v).over(rows_w if frame == "rows" else range_w))
        elif kind == "lag":
            local = local.withColumn(f"_l{i}", F.lag(v).over(base))
            need_first = True
        elif kind == "last":
            local = local.withColumn(f"_l{i}", F.last(v, ignorenulls=True).over(rows_w))
        elif kind == "total":
            local = local.withColumn(f"_l{i}", F.sum(v).over(whole_w))
        elif kind == "first":
            local = local.withColumn(f"_l{i}", F.first(F.struct(v.alias("v"))).over(rows_w))
        else:
            raise ValueError(f"unknown scan kind {kind!r}")
    if need_first:
        local = local.withColumn("_seg_first", F.row_number().over(base) == 1)
    ordkey = F.struct(*order)
    aggs = []
    for i, (_, kind, _, _) in enumerate(specs):
        v = F.col(f"_v{i}")
        if kind in ("sum", "total"):
            aggs.append(F.sum(v).alias(f"_e{i}"))
        elif kind == "first":
            aggs.append(F.min_by(F.struct(v.alias("v")), ordkey).alias(f"_e{i}"))
        elif kind == "lag":
            aggs.append(F.max_by(F.struct(v.alias("v")), ordkey).alias(f"_e{i}"))
        else:
            aggs.append(F.max_by(v, F.when(v.isNotNull(), ordkey)).alias(f"_e{i}"))
    per = _edge_rows(d, by).groupBy(CHUNK, *by).agg(*aggs)
    prev_w = Window.partitionBy(*by).orderBy(CHUNK)
    before_w = prev_w.rowsBetween(Window.unboundedPreceding, -1)
    upto_w = prev_w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carries = []
    for i, (_, kind, _, _) in enumerate(specs):
        e = F.col(f"_e{i}")
        if kind == "sum":
            carries.append(F.sum(e).over(before_w).alias(f"_c{i}"))
        elif kind == "total":
            carries.append(F.sum(e).over(Window.partitionBy(*by)).alias(f"_c{i}"))
        elif kind == "first":
            carries.append(F.first(e).over(upto_w).alias(f"_c{i}"))
        elif kind == "lag":
            carries.append(F.lag(e).over(prev_w).alias(f"_c{i}"))
        else:
            carries.append(F.last(e, ignorenulls=True).over(before_w).alias(f"_c{i}"))
    summary = per.select(CHUNK, *by, *carries)
    res = _attach(local, summary, by)
    for i, (out, kind, _, _) in enumerate(specs):
        loc, car = F.col(f"_l{i}"), F.col(f"_c{i}")
        if kind == "sum":
            val = F.when(car.isNull(), loc).when(loc.isNull(), car).otherwise(car + loc)
        elif kind == "lag":
            val = F.when(F.col("_seg_first"), car.getField("v")).otherwise(loc)
        elif kind == "total":
            val = F.coalesce(car, loc)
        elif kind == "first":
            val = F.coalesce(car, loc).getField("v")
        else:
            val = F.coalesce(loc, car)
        res = res.withColumn(out, val)
    drop = [f"_{p}{i}" for i in range(len(specs)) for p in "vlc"] + (["_seg_first"] if need_first else [])
    res = res.drop(*drop)
    return res.drop(_G) if added else res


def cumsum(d: DataFrame, value, by: Sequence[str], order: Sequence, out: str,
           frame: str = "rows") -> DataFrame:
    """Running sum of ``value`` per ``by`` in ``order`` on a chunked frame (NULLs skipped,
    NULL until the first non-NULL value, as SQL ``sum`` over a window).

    ``frame='rows'``: one row at a time; ``frame='range'``: peers (equal order values)
    share the value, as the default frame of an ordered SQL window does — this needs the
    frame to be chunked on exactly ``(by..., order...)`` so that peers share a chunk.
    """
    return scan_all(d, by, order, [(out, "sum", value, frame)])


def lag(d: DataFrame, value, by: Sequence[str], order: Sequence, out: str,
        first_flag: str | None = None) -> DataFrame:
    """Previous row's ``value`` per ``by`` in ``order`` (NULL on the first row of a key).

    With ``first_flag`` a boolean column marks the first row of each key overall.
    """
    if not first_flag:
        return scan_all(d, by, order, [(out, "lag", value)])
    marked = scan_all(d, by, order, [(out, "lag", F.struct(F.lit(True).alias("t"), value.alias("x")))])
    return (marked.withColumn(first_flag, F.col(out).isNull())
                  .withColumn(out, F.col(out).getField("x")))


def last_non_null(d: DataFrame, value, by: Sequence[str], order: Sequence, out: str) -> DataFrame:
    """Most recent non-NULL ``value`` up to and including the current row, per ``by``."""
    return scan_all(d, by, order, [(out, "last", value)])
