"""Helpers shared by the training-data operators."""

from __future__ import annotations

import string
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import ledgerflow.llm
from ledgerflow.session import ensure_checkpoint_dir
from ledgerflow.sources.tables import Tables

# Functions that run in tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(ledgerflow.llm)

#: The ASCII white space that separates words and pads lines.
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).get("documents")


def text_of(name: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only (``lower`` would fold every script)."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def hash128(c: Column) -> Column:
    """128-bit content hash as 16 bytes."""
    return F.unhex(F.md5(c.cast("binary")))


def row_key() -> Column:
    """16 bytes that name a document by id and text. Rows that agree in both get the same
    answer from every operator, so the key may stand for the row in joins."""
    return hash128(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\x00"), text_of()))


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files, so that a lost
    executor costs a re-read and not a recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batch_limits(spark: SparkSession) -> None:
    """Arrow batches of at most 64 MB, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to a fresh folder of the shared checkpoint folder and go on from
    the files. Unlike ``materialize`` a later read takes only the columns it needs."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
