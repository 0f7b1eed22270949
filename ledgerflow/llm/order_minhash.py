"""Order MinHash fingerprints, sensitive to edit distance.

The k-mers of a text (k code points) are numbered by occurrence, so that repeats are different
elements. Each of ``SKETCHES`` hash orders selects the ``2`` smallest elements; they are taken
in the order in which they stand in the text, and the pair's hash (16 bits) is one entry of the
signature. Two texts are as like as the share of equal entries: moved as well as changed text
lowers it.

``with_edits`` reads the documents in descending id order, equal ids by text hash. Ids are cut into
chunks at sampled quantiles; an id that fills whole chunks, and rows without an id, are cut into
ranges of the text hash, and their repeated rows travel as one row with a count. The chunks are
dealt out by hash, and each task streams its chunks sorted, one document ahead; a chunk also gets
the first document of the next one, so no row needs another task. The text is shuffled once and no
window spans the table.

Defined results: null text is the empty text, whose signature is that of one empty k-mer; texts
shorter than k are one k-mer; very long texts are read whole, ``CHUNK`` k-mers at a time; documents
without an id come last; equal ids are ordered by text hash; rows that repeat an id and its text are
one document: the next document is the next different one, and after the last comes the first
(itself if it is the only one); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import batch_limits, hash128, shuffle_partitions, text_of

K = 8                       # code points of a k-mer
SKETCHES = 64               # entries of a signature
CHUNK = 2_048               # k-mers ordered at a time
CHUNKS = 4                  # of ids for each shuffle partition, and as many of rows without an id
ROWS = 4_096                # that leave a task at a time
MIX = np.uint64(0x9E3779B97F4A7C15)
ODD = np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * MIX
    return x ^ (x >> np.uint64(29))


def _orders() -> tuple[np.ndarray, np.ndarray]:
    seed = _mixed(np.arange(1, 2 * SKETCHES + 1, dtype=np.uint64) * ODD)
    return (seed[:SKETCHES] >> np.uint64(32)).astype(np.uint32), (seed[SKETCHES:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def elements(text: str) -> np.ndarray:
    """64-bit hashes of the occurrence-numbered k-mers, in text order."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if len(h) < K:
        digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        return np.frombuffer(digest, dtype="<u8").copy()
    h, size = _mixed(h + np.uint64(1)), 1
    while size < K:                                          # hashes of 2, 4, 8 code points
        h = _mixed(h[:-size] * ODD + h[size:])
        size *= 2
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    if not new.all():
        place = np.arange(len(h))
        number = np.empty(len(h), np.uint64)
        number[order] = place - np.maximum.accumulate(np.where(new, place, 0))
        h = _mixed(h + number * MIX)
    return h


def signature(text: str) -> np.ndarray:
    """SKETCHES entries of 16 bits."""
    h = elements(text)
    low, (xor, odd) = h.astype(np.uint32), _orders()
    values, places, rows = [], [], np.arange(SKETCHES)
    for lo in range(0, len(h), CHUNK):
        x = (low[None, lo:lo + CHUNK] ^ xor[:, None]) * odd[:, None]
        for _ in range(min(2, x.shape[1])):
            at = x.argmin(axis=1)
            values.append(x[rows, at].astype(np.uint64))
            places.append(at + lo)
            x[rows, at] = 0xFFFFFFFF
    values, places = np.stack(values, axis=1), np.stack(places, axis=1)
    key = (values << np.uint64(32)) | places.astype(np.uint64)          # ties go to the earlier one
    best = np.take_along_axis(places, np.argsort(key, axis=1)[:, :2], axis=1)
    best.sort(axis=1)                                                   # back to text order
    out = _mixed(h[best[:, 0]] * ODD + (h[best[:, 1]] if best.shape[1] > 1 else MIX))
    return (out >> np.uint64(48)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by chunk, sorted, each chunk's guest (the next chunk's first) last. One document
    is held, with the number of its rows."""
    held = own = None                      # a document (chunk, doc_id, hash, text), its signature
    copies = 0
    rows: list[tuple] = []

    def frames(least: int) -> Iterator[pd.DataFrame]:
        if len(rows) >= least:
            yield pd.DataFrame(rows, columns=COLUMNS).astype({"doc_id": "Int64"})
            rows.clear()

    for pdf in batches:
        for chunk, guest, doc, digest, text, n in zip(*(pdf[c] for c in ("chunk", "guest", "doc_id", "digest", "text", "n"))):
            doc = None if pd.isna(doc) else int(doc)
            if held and held[:3] == (chunk, doc, digest) and not guest:
                copies += n
                continue
            sign = None
            if held and held[0] == chunk:
                sign = own if held[2] == digest else signature(text)
                row = _edited(held[1], held[3], text, own, sign)
                for _ in range(copies):
                    rows.append(row)
                    yield from frames(ROWS)
            held = None if guest else (chunk, doc, digest, text)
            own = None if guest else (signature(text) if sign is None else sign)
            copies = n
        yield from frames(1)


def _edited(doc: int | None, old: str, text: str, own: np.ndarray, sign: np.ndarray) -> tuple:
    cut = len(old) // 3
    edited = old[:len(old) - cut] + text[:cut]
    changed = own if edited == old else signature(edited)
    return (doc, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own.tobytes().hex(),
            changed.tobytes().hex(), likeness(own, changed), likeness(own, sign))


class Chunks:
    """Numbers the chunks in descending order of (id, text hash). ``cuts`` are quantiles of the
    ids; an id that is a quantile several times gets as many ranges of the text hash, rows
    without an id get ``nulls``."""

    def __init__(self, cuts: list[int], nulls: int):
        self.cuts = np.array(sorted(set(cuts)), np.int64)
        often = np.array([n if n > 1 else 0 for _, n in sorted(Counter(cuts).items())], np.int64)
        self.often, self.nulls = often, nulls
        # interval j holds the ids below the j-th largest cut's upper neighbour, down to the cut itself
        self.base = np.cumsum(np.r_[0, 1 + often[::-1]])
        self.hot = [int(c) for c, n in zip(self.cuts, often) if n]

    def split(self, doc_id: Column) -> Column:
        """Whether a row's chunk depends on its text."""
        return doc_id.isNull() | doc_id.isin(self.hot)

    def number(self):
        """A column function of the id and the first 32 bits of the text hash (of split rows)."""
        cuts, often, base, nulls = self.cuts, self.often, self.base, self.nulls

        @F.pandas_udf("int")
        def find(doc_id: pd.Series, part: pd.Series) -> pd.Series:
            ids = doc_id.to_numpy(np.int64, na_value=0) if doc_id.isna().any() else doc_id.to_numpy(np.int64)
            place = np.searchsorted(cuts, ids, "right")                   # of the cut at or under an id, from 1
            at = base[len(cuts) - place]
            if part.notna().any():
                p = part.to_numpy(np.int64, na_value=0)
                inside = 1 + (p * np.r_[0, often][place] >> 32)
                at = np.where(part.notna(), at + inside, at)
                at = np.where(doc_id.isna(), base[-1] + 1 + (p * nulls >> 32), at)
            return pd.Series(at.astype(np.int32))
        return find


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def with_edits(docs: DataFrame) -> DataFrame:
    """For every row the fingerprint of its text, of its text edited by the next document's
    start, and the likeness of the fingerprint to the edited text's and the next document's."""
    spark = docs.sparkSession
    batch_limits(spark)
    n = CHUNKS * shuffle_partitions(spark)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else None
    chunks = Chunks(cuts or [], n)
    digest = hash128(F.col("text"))
    split = chunks.split(F.col("doc_id"))
    own = docs.select("doc_id", text_of().alias("text")).withColumn("part", F.when(split, digest))
    own = own.withColumn("chunk", chunks.number()("doc_id", F.conv(F.hex(F.substring("part", 1, 4)), 16, 10).cast("long")))
    # the first document of each chunk, the guest of the chunk before it; one row per chunk
    heads = sorted(own.groupBy("chunk").agg(F.max("doc_id"), F.min("part")).collect())
    turns = [(head, part, heads[i - 1][0]) for i, (_, head, part) in enumerate(heads)]       # the first goes to the last
    guests = F.broadcast(spark.createDataFrame(turns, "head long, head_part binary, to int"))
    first = (own.join(guests, own["doc_id"].eqNullSafe(guests["head"]) & own["part"].eqNullSafe(guests["head_part"]))
             .groupBy("to", "head").agg(F.min_by("text", digest).alias("text"))
             .select(F.col("to").alias("chunk"), F.lit(True).alias("guest"), F.col("head").alias("doc_id"), "text", F.lit(1).alias("n")))
    one = own.filter(~split).select("chunk", F.lit(False).alias("guest"), "doc_id", "text", F.lit(1).alias("n"))
    more = (own.filter(split).groupBy("chunk", "doc_id", "part").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
            .select("chunk", F.lit(False).alias("guest"), "doc_id", "text", "n"))
    every = one.union(more).union(first)
    every = every.select("chunk", "guest", "doc_id", digest.alias("digest"), "text", "n")
    return (every.repartition(shuffle_partitions(spark), "chunk")
            .sortWithinPartitions("chunk", "guest", F.col("doc_id").desc_nulls_last(), "digest")
            .mapInPandas(_stream, SCHEMA))
