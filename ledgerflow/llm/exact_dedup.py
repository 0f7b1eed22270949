"""Exact dedup: group by a 128-bit content hash, compare bytes inside the groups, keep one id.

Texts are equal when their bytes agree after lower-casing A-Z. ``byte_classes`` aggregates by
(hash, text): the hash spreads the rows, the text beside it compares the bytes, so two texts
that collide in the hash stay apart. The aggregation combines copies in every map task, so a
text that holds a third of all rows sends one row per task. Rows then find their class by
(hash, SHA-256); both join sides are plain exchanges, which adaptive execution splits when one
class is hot. Only built-in functions are used.

Defined results: null text is the empty text; a null id never beats another id; rows that
repeat an id and its text are one document and share its answer (``drop_exact_duplicates``
keeps one of them); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import ascii_lower, hash128, text_of


def _digest(norm: str) -> Column:
    return F.unhex(F.sha2(F.col(norm).cast("binary"), 256))


def byte_classes(docs: DataFrame, keep: str = "smallest", hash_of=hash128) -> DataFrame:
    """One row per distinct normalised text: (h, sha, keep_id, group_size)."""
    best = {"smallest": F.min, "largest": F.max}[keep]
    return (docs.select("doc_id", ascii_lower(text_of()).alias("norm"))
            .groupBy(hash_of(F.col("norm")).alias("h"), "norm")
            .agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            .select("h", _digest("norm").alias("sha"), "keep_id", "group_size"))


def exact_dedup(docs: DataFrame, keep: str = "smallest", hash_of=hash128) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = (docs.select("doc_id", ascii_lower(text_of()).alias("norm"))
            .select("doc_id", hash_of(F.col("norm")).alias("h"), _digest("norm").alias("sha")))
    return (rows.join(byte_classes(docs, keep, hash_of), ["h", "sha"])
            .select("doc_id", "keep_id", "group_size",
                    F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
                    F.lower(F.hex("sha")).alias("text_sha256")))


def drop_exact_duplicates(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rank 1 of a window by (hash, text): Spark applies the rank limit before the exchange too,
    so each map task sends one row per text however many copies it holds.
    """
    order = F.col("doc_id").asc_nulls_last() if keep == "smallest" else F.col("doc_id").desc_nulls_last()
    w = Window.partitionBy("_llm_hash", "_llm_norm").orderBy(order)
    return (docs.withColumn("_llm_norm", ascii_lower(text_of()))
            .withColumn("_llm_hash", hash128(F.col("_llm_norm")))
            .withColumn("_llm_rank", F.row_number().over(w))
            .filter("_llm_rank = 1").drop("_llm_norm", "_llm_hash", "_llm_rank"))
