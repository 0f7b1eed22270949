"""Corpus pipeline: documents -> training sequences, one operator a stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm.common import documents
from ledgerflow.llm.exact_dedup import drop_exact_duplicates
from ledgerflow.llm.lang_id import with_language
from ledgerflow.llm.mixing import mixed_rows
from ledgerflow.llm.packing import VOCABULARY, markers_of, pack
from ledgerflow.llm.simhash import drop_near_duplicates
from ledgerflow.session import ensure_checkpoint_dir

MIN_SCORE = 0.4             # language probability below which a document goes
MAX_REPEATS = 2.0           # times a small source is read while the largest is read once
SEQUENCE = 1024             # tokens


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no letters, or no language of at least MIN_SCORE."""
    return with_language(docs, MIN_SCORE).select(docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the largest id."""
    return drop_exact_duplicates(docs, keep="largest").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return drop_near_duplicates(docs, shingle=3, max_bits=2).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, those of small sources up to MAX_REPEATS times."""
    return mixed_rows(docs, max_repeats=MAX_REPEATS).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    pieces = pack(docs, length=SEQUENCE, markers=markers_of(VOCABULARY))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language), ("exact_dedup", exact_copies), ("simhash_near_dedup", near_copies),
          ("mixing", mixing), ("packing", packing)]
#: Neither the language model nor XXH64 fingerprints nor tokens have a DuckDB form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet, in a fresh folder
    of the shared checkpoint folder, before the next reads them."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
