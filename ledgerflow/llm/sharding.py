"""Sharding by sampled splitters: fine ranges of a key, joined into shards of near-equal bytes.

The key is (hash of the text, id), so equal texts lie side by side. A sample of keys, drawn in
proportion to size and bounded by ``SAMPLE``, gives the boundaries of ``ranges`` fine ranges;
a boundary moves to the start of its group of equal texts unless the group holds several
boundaries, that is, more than a range. Rows that agree in id and text are counted and go on as
pieces of at most a range each. All pieces are then measured exactly per range, overfull ranges
are subdivided by hash, or by the pieces' numbers, and the cells in key order go to the shard in
which their middle byte falls. Slots count rows within a cell, behind the cells before it in the
shard.

Collected to the driver: the sample and one row per cell, both bounded by parameters and not by
the data. Defined results: null text has size 1; a null id sorts first; rows that agree in id
and text get neighbouring slots unless they hold more than a range; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import materialize, text_of

SAMPLE = 16_384             # keys drawn, on average, at most
RANGES = 64                 # fine ranges per shard
MIN_ID = -(1 << 63)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, key, at (the id, null first), size, text_crc32."""
    return docs.select("doc_id", F.xxhash64(text_of()).alias("key"), F.coalesce("doc_id", F.lit(MIN_ID)).alias("at"),
                       (F.octet_length(text_of()) + 1).cast("long").alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"))


def pieces_of(groups: DataFrame, goal: float) -> DataFrame:
    """Groups of ``n`` equal rows as pieces of at most ``goal`` bytes, or one row: copies, bytes,
    part (the number within the group) and many (whether there is more than one)."""
    return (groups.withColumn("most", F.greatest(F.lit(1), F.floor(F.lit(goal) / F.col("size"))).cast("long"))
            .withColumn("last", F.ceil(F.col("n") / F.col("most")).cast("long") - 1)
            .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
            .withColumn("copies", F.least(F.col("most"), F.col("n") - F.col("most") * F.col("part")))
            .select("doc_id", "key", "at", "size", "text_crc32", "part", "copies", (F.col("size") * F.col("copies")).alias("bytes"),
                    (F.col("last") > 0).alias("many")))


def _uniform(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns, F.lit("draw")), F.lit(1 << 52)) / F.lit(float(1 << 52))


def splitters(rows: DataFrame, ranges: int, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(key, id) boundaries from a size-weighted sample; a range starts at its boundary."""
    total = rows.agg(F.sum("bytes")).first()[0] or 1
    step = total / sample
    drawn = rows.filter(_uniform("key", "at", "part") < F.col("bytes") / F.lit(step)).select("key", "at", "bytes").collect()
    drawn = sorted((r["key"], r["at"], max(r["bytes"], step)) for r in drawn)
    if not drawn:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    middle = np.cumsum([w for *_, w in drawn]) - np.array([w for *_, w in drawn]) / 2
    chosen = np.searchsorted(middle, middle[-1] * np.arange(1, ranges) / ranges)
    cuts = sorted({drawn[i][:2] for i in chosen})
    first = {k: d for k, d in reversed(cuts)}
    cuts = sorted({(k, MIN_ID if d == first[k] else d) for k, d in cuts})
    return np.array([k for k, _ in cuts], np.int64), np.array([d for _, d in cuts], np.int64)


def range_of(keys: np.ndarray, ids: np.ndarray):
    """A column function: the number of boundaries at or before (key, id)."""
    @F.pandas_udf("int")
    def find(key: pd.Series, at: pd.Series) -> pd.Series:
        k, d = key.to_numpy(np.int64), at.to_numpy(np.int64)
        lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        out = hi.copy()
        for start in np.unique(lo[hi - lo > 1]):                  # groups larger than a range
            own = (lo == start) & (hi - lo > 1)
            end = hi[own][0]
            out[own] = start + np.searchsorted(ids[start:end], d[own], "right")
        return pd.Series(out.astype(np.int32))
    return find


def shard_by_bytes(docs: DataFrame, shards: int = 16, ranges: int = RANGES, sample: int = SAMPLE) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row; shards have near-equal bytes."""
    spark, n = docs.sparkSession, shards * ranges
    groups = materialize(measured(docs).groupBy("doc_id", "key", "at", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n")))
    rows = pieces_of(groups, (groups.agg(F.sum(F.col("size") * F.col("n"))).first()[0] or 1) / n)
    keys, ids = splitters(rows, n, sample)
    rows = materialize(rows.withColumn("range", range_of(keys, ids)("key", "at")))
    found = rows.groupBy("range").agg(F.sum("bytes").alias("bytes"), F.min("key") != F.max("key")).collect()
    goal = sum(r["bytes"] for r in found) / n if found else 1
    parts = [(r["range"], max(1, math.ceil(r["bytes"] / goal)) if r["bytes"] > 2 * goal else 1, r[2]) for r in found]
    pieces = F.broadcast(spark.createDataFrame(parts, "range int, parts int, mixed boolean"))       # one row per range
    by = F.when(F.col("many"), F.col("part")).when(F.col("mixed"), F.xxhash64("key")).otherwise(F.xxhash64("key", "at"))
    rows = rows.join(pieces, "range").withColumn("sub", F.pmod(by, "parts").cast("int"))
    cells = sorted(tuple(r) for r in rows.groupBy("range", "sub").agg(F.sum("bytes"), F.sum("copies")).collect())
    total, before, slots, plan = sum(c[2] for c in cells), 0, {}, []
    for at, sub, size, count in cells:
        shard = min(shards - 1, int((before + size / 2) * shards // total))
        plan.append((at, sub, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + count
        before += size
    plan = F.broadcast(spark.createDataFrame(plan, "range int, sub int, shard int, base long"))     # one row per cell
    order = Window.partitionBy("range", "sub").orderBy("key", "at", "text_crc32", "size", "doc_id", "part")
    end = F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.col("base") + F.col("end") - F.col("copies")
    return (rows.withColumn("end", end).join(plan, ["range", "sub"])
            .select("doc_id", "size", "text_crc32", "shard", F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("slot")))


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Write the documents as one folder per shard; ids must be unique here."""
    plan = shard_by_bytes(docs, shards).select("doc_id", "shard", "slot")
    (docs.join(plan, "doc_id").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.mode("overwrite").partitionBy("shard").parquet(path))
