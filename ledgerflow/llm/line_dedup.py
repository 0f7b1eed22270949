"""Reversible line dedup: exact reference counts, with sharded cuckoo filters in front.

A line's key is the 128-bit hash of the line without white space at its ends, A-Z lower-cased.
``references`` counts for every key the documents that hold it; ``insert`` and ``delete`` add
and subtract the counts of a batch, so a deleted document leaves no trace. ``filters`` keeps,
per shard of keys, a cuckoo filter of the keys at or over the threshold; ``update_filters``
adds the keys that a batch lifted over it and removes those that fell below.

``drop_lines`` rewrites documents. Very frequent keys are told by a broadcast of at most
``MAX_HEAVY`` keys: no more keys than that can each have over 1/MAX_HEAVY of all references.
Their lines are spread by document. All other lines go to their key's shard, where no key can
be hot any more, and stream past the shard's filter; what passes is checked against the exact
counts, so a false positive drops nothing.

Defined results: null text is one empty line; an empty key never drops; every row counts as a
document of its own; rows that repeat an id and its text get the same answer; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import (WHITE, ascii_lower, batch_limits, hash128, materialize, row_key,
                                   shuffle_partitions, text_of)
from ledgerflow.llm.cuckoo import CuckooFilter

MAX_HEAVY = 10_000          # keys in the broadcast, 16 bytes each
SHARD_KEYS = 50_000         # frequent keys in one filter, on average


def _line_keys(docs: DataFrame, *columns: Column) -> DataFrame:
    """(columns, key): every distinct non-empty key of every document."""
    lines = F.transform(F.split(ascii_lower(text_of()), "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)))
    keys = F.transform(F.array_distinct(F.filter(lines, lambda x: x != "")), hash128)
    return docs.select(*columns, F.explode(keys).alias("key"))


def references(docs: DataFrame) -> DataFrame:
    """The exact table: key, n_docs."""
    return _line_keys(docs).groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"))


def _merged(refs: DataFrame, docs: DataFrame, sign: int) -> DataFrame:
    both = refs.union(references(docs).withColumn("n_docs", sign * F.col("n_docs")))
    return both.groupBy("key").agg(F.sum("n_docs").alias("n_docs")).filter("n_docs > 0")


def insert(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """The reference table after ``docs`` came in."""
    return _merged(refs, docs, 1)


def delete(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """The reference table after ``docs``, all of them inserted before, went."""
    return _merged(refs, docs, -1)


def _shard(shards: int) -> Column:
    head = F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long")
    return (head % F.lit(shards)).cast("int").alias("shard")


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    cuckoo = CuckooFilter.of(sorted(pdf["key"]))
    return pd.DataFrame({"shard": pdf["shard"][:1].to_numpy(), "cuckoo": [cuckoo.to_bytes()]})


def _frequent(refs: DataFrame, min_docs: int, shards: int) -> DataFrame:
    return refs.filter(F.col("n_docs") >= min_docs).select("key", _shard(shards))


def filters(refs: DataFrame, min_docs: int, shards: int) -> DataFrame:
    """(shard, cuckoo): one filter for every shard with a key in at least ``min_docs`` documents."""
    return _frequent(refs, min_docs, shards).groupBy("shard").applyInPandas(_build, "shard int, cuckoo binary")


def update_filters(cuckoos: DataFrame, before: DataFrame, after: DataFrame, min_docs: int, shards: int) -> DataFrame:
    """``cuckoos`` after the reference table went from ``before`` to ``after``: only keys that
    crossed the threshold travel. Shards whose filter is full are built anew from ``after``."""
    was = _frequent(before, min_docs, shards).withColumn("was", F.lit(1))
    now = _frequent(after, min_docs, shards).withColumn("now", F.lit(1))
    crossed = (was.join(now, ["key", "shard"], "full_outer").filter("was IS NULL OR now IS NULL")
               .select("key", "shard", F.col("now").isNotNull().alias("up")))

    def apply(old: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
        shard = (old if len(old) else change)["shard"].iloc[0]
        up = sorted(change["key"][change["up"].astype(bool)])
        if len(old):
            cuckoo = CuckooFilter.from_bytes(old["cuckoo"].iloc[0])
            for key in sorted(change["key"][~change["up"].astype(bool)]):
                cuckoo.remove(key)
            blob = cuckoo.to_bytes() if all([cuckoo.add(key) for key in up]) else None
        else:
            blob = CuckooFilter.of(up).to_bytes()
        return pd.DataFrame({"shard": [shard], "cuckoo": [blob]})

    changed = materialize(cuckoos.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(apply, "shard int, cuckoo binary"))
    full = changed.filter("cuckoo IS NULL").select("shard")
    anew = _frequent(after, min_docs, shards).join(full, "shard", "left_semi")
    return changed.filter("cuckoo IS NOT NULL").union(anew.groupBy("shard").applyInPandas(_build, "shard int, cuckoo binary"))


def _probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by shard, the shard's filter first; lines that may be frequent go on."""
    shard, cuckoo = None, None
    for pdf in batches:
        for at, part in pdf.groupby("shard", sort=False):
            if at != shard:
                shard, cuckoo = at, None
            if (own := part["cuckoo"].notna()).any():
                cuckoo = CuckooFilter.from_bytes(part["cuckoo"][own].iloc[0])
                part = part[~own]
            keep = part["heavy"].to_numpy(dtype=bool)
            if cuckoo is not None and len(part):
                keep = keep | cuckoo.probe(part["key"].tolist())
            yield part.loc[keep, ["rk", "key", "heavy"]]


def frequent_lines(docs: DataFrame, refs: DataFrame, min_docs: int) -> DataFrame:
    """(rk, keys): the keys to drop of every document that has some. ``refs`` is read several
    times: give a materialised or stored table."""
    spark = docs.sparkSession
    total, frequent = refs.agg(F.sum("n_docs"), F.count_if(F.col("n_docs") >= min_docs)).first()
    shards = max(8 * shuffle_partitions(spark), math.ceil((frequent or 0) / SHARD_KEYS))
    floor = max(min_docs, (total or 0) // MAX_HEAVY + 1)
    heavy = refs.filter(F.col("n_docs") >= floor).select("key", F.lit(True).alias("heavy"))
    spread = F.pmod(F.xxhash64("rk"), F.lit(shards)).cast("int")
    lines = (_line_keys(docs, row_key().alias("rk")).join(F.broadcast(heavy), "key", "left")
             .select("rk", "key", F.coalesce("heavy", F.lit(False)).alias("heavy"), F.lit(None).cast("binary").alias("cuckoo"),
                     F.when(F.col("heavy"), spread).otherwise(_shard(shards)).alias("shard"), F.lit(1).alias("kind")))
    cuckoos = filters(refs, min_docs, shards).select(
        F.lit(None).cast("binary").alias("rk"), F.lit(None).cast("binary").alias("key"), F.lit(False).alias("heavy"),
        "cuckoo", "shard", F.lit(0).alias("kind"))
    may = (lines.union(cuckoos).repartition(shuffle_partitions(spark), "shard")
           .sortWithinPartitions("shard", "kind")
           .mapInPandas(_probe, "rk binary, key binary, heavy boolean"))
    may = materialize(may)
    exact = refs.filter(F.col("n_docs") >= min_docs).select("key")
    sure = may.filter("heavy").select("rk", "key").union(
        may.filter("NOT heavy").join(exact, "key", "left_semi").select("rk", "key"))
    return sure.groupBy("rk").agg(F.collect_set("key").alias("keys"))


def _rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    white = WHITE.encode()
    for pdf in batches:
        out = []
        for text, keys in zip(pdf["text"], pdf["keys"]):
            lines = text.split("\n")
            n = len(lines)
            if keys is not None and len(keys):
                gone = set(keys)
                lines = [x for x in lines
                         if not (key := x.encode().strip(white).lower()) or hashlib.md5(key).digest() not in gone]
                text = "\n".join(lines)
            out.append((n, n - len(lines), text))
        counts = pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept_text"], index=pdf.index)
        yield pd.concat([pdf[["doc_id"]], counts], axis=1)


def drop_lines(docs: DataFrame, min_docs: int = 10, refs: DataFrame | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for every row: without the lines whose key is in
    at least ``min_docs`` documents of ``refs`` (by default the table of ``docs`` itself)."""
    batch_limits(docs.sparkSession)
    refs = materialize(references(docs)) if refs is None else refs
    gone = frequent_lines(docs, refs, min_docs)
    return (docs.select(row_key().alias("rk"), "doc_id", text_of().alias("text")).join(gone, "rk", "left")
            .select("doc_id", "text", "keys")
            .mapInPandas(_rewrite, "doc_id long, n_lines long, n_dropped long, kept_text string"))
