"""SimHash near-dedup by anchor-point covering.

A fingerprint is cut into two 32-bit halves; of two fingerprints at most t bits apart, one half
is at most t // 2 apart, or the other at most t - t // 2 - 1. The anchors of a half are the
words of a covering code: the perfect (31, 26) code beside one free bit, whose covering radius
is 1. Each fingerprint goes to every anchor within the covering radius plus the half's
threshold, so two linked fingerprints meet at the anchor nearest to one of them. Fingerprints
are compared per anchor, bit by bit over all 64; only a spanning set of links leaves an anchor,
so a group of near copies costs its size and not its square.

An anchor with over ``MAX_ANCHOR`` fingerprints is cut again by the anchors of the other half,
with the whole threshold: what is left has at most 529 x 5,489 different fingerprints at t = 2,
whatever the input. Within a large group, neighbours are looked up (one sorted search per bit
mask) where that is less work than comparing its pairs; ``max_bits`` is meant to be small, the
copies at the anchors grow with its binomials (2 bits: 34 + 1 a fingerprint, 4 bits: 188).

Defined results: null text is the empty text, with fingerprint zero, which links like any
other; equal fingerprints are one node, however many rows have them; a null id never names a
component unless all its ids are null; repeated rows share their answer; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, islice
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import batch_limits, materialize, row_key, shuffle_partitions, text_of
from ledgerflow.llm.components import connected_components

SEED = 42
CHUNK = 1 << 15             # shingles whose bits are counted at a time
MAX_ANCHOR = 50_000         # fingerprints at one anchor before it is cut again
MAX_PAIRWISE = 2_048        # fingerprints of a group that are compared pairwise together with other groups
PAIRS_A_SEARCH = 32         # pairs that are compared in the time of one sorted search


def fingerprint(text: str, shingle: int = 3) -> int:
    """64-bit SimHash: a bit is set if set in over half of the shingles' hashes."""
    words = text.encode().lower().split()                  # both know ASCII only
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    spans = zip([0, *ends], ends[size - 1:])
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64), len(words) - size + 1
    for _ in range(0, n, CHUNK):
        h = np.fromiter((digest(joined[a:b - 1], SEED) for a, b in islice(spans, CHUNK)), dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, keys: bool = False) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for every row, with its ``row_key`` on request."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([fingerprint(t, shingle) for t in pdf["text"]], dtype=np.uint64).view(np.int64)
            yield pdf.drop(columns="text").assign(fp=fp)

    batch_limits(docs.sparkSession)
    more = [row_key().alias("rk")] * keys
    return docs.select("doc_id", *more, text_of().alias("text")).mapInPandas(run, f"doc_id long,{' rk binary,' * keys} fp long")


def reach(radius: int) -> list[np.ndarray]:
    """By syndrome: the bit patterns of at most ``radius`` bits that lead from a half with that
    syndrome to a code word. Bits 1 .. 31 are the code's places, bit 0 is free."""
    out: list[list[int]] = [[] for _ in range(32)]
    for n in range(radius + 1):
        for bits in combinations(range(32), n):
            s = 0
            for b in bits:
                s ^= b
            out[s].append(sum(1 << b for b in bits))
    return [np.array(x, dtype=np.uint64) for x in out]


def _syndrome(half: np.ndarray) -> np.ndarray:
    s = np.zeros(len(half), dtype=np.int64)
    for b in range(1, 32):
        s ^= np.where((half >> np.uint64(b)) & np.uint64(1), b, 0)
    return s


def anchors(half: np.ndarray, patterns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(index, anchor): all code words within the radius of ``patterns`` of every 32-bit half."""
    s, index, anchor = _syndrome(half), [], []
    for syndrome, to in enumerate(patterns):
        at = np.flatnonzero(s == syndrome)
        if len(at) and len(to):
            index.append(np.repeat(at, len(to)))
            anchor.append((half[at][:, None] ^ to[None, :]).ravel())
    return np.concatenate(index or [np.zeros(0, np.int64)]), np.concatenate(anchor or [np.zeros(0, np.uint64)])


def _half(fp: np.ndarray, piece: int) -> np.ndarray:
    u = fp.view(np.uint64)
    return (u >> np.uint64(32)) if piece == 0 else (u & np.uint64(0xFFFFFFFF))


def _at_anchors(nodes: DataFrame, max_bits: int) -> DataFrame:
    """(anchor, fp): every fingerprint at its anchors of both halves."""
    reaches = [reach(1 + t) if t >= 0 else None for t in (max_bits // 2, max_bits - max_bits // 2 - 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = pdf["fp"].to_numpy(dtype=np.int64)
            for piece, patterns in enumerate(reaches):
                if patterns is not None:
                    at, anchor = anchors(_half(fp, piece), patterns)
                    yield pd.DataFrame({"anchor": anchor.astype(np.int64) | (piece << 32), "fp": fp[at]})

    return nodes.select("fp").mapInPandas(run, "anchor long, fp long")


def _cut_again(placed: DataFrame, max_bits: int) -> DataFrame:
    """(anchor, sub, fp): fingerprints of an overfull anchor at the other half's anchors."""
    patterns = reach(1 + max_bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp, anchor = pdf["fp"].to_numpy(dtype=np.int64), pdf["anchor"].to_numpy(dtype=np.int64)
            for piece in (0, 1):
                own = np.flatnonzero(anchor >> 32 == piece)
                for lo in range(0, len(own), 1000):
                    part = own[lo:lo + 1000]
                    at, sub = anchors(_half(fp[part], 1 - piece), patterns)
                    yield pd.DataFrame({"anchor": anchor[part][at], "sub": sub.astype(np.int64), "fp": fp[part][at]})

    return placed.mapInPandas(run, "anchor long, sub long, fp long")


def _spanning(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index of each component of n nodes under the links a - b (and ``label``)."""
    label = np.arange(n) if label is None else label
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not (label[label] == label).all():
            label = label[label]


def _group_links(fp: np.ndarray, max_bits: int) -> np.ndarray:
    """Component label within one large group of sorted, different fingerprints. Neighbours are
    looked up, one sorted search per bit mask, unless comparing the pairs is less work."""
    label = np.arange(len(fp))
    if len(fp) < PAIRS_A_SEARCH * sum(comb(64, n) for n in range(1, max_bits + 1)):
        for step in range(1, len(fp)):
            hit = np.flatnonzero(np.bitwise_count(fp[:-step] ^ fp[step:]) <= max_bits)
            if len(hit):
                label = _spanning(len(fp), hit, hit + step, label)
        return label
    for n in range(1, max_bits + 1):
        for bits in combinations(range(64), n):
            other = fp ^ np.uint64(sum(1 << b for b in bits))
            at = np.minimum(np.searchsorted(fp, other), len(fp) - 1)
            hit = np.flatnonzero((fp[at] == other) & (fp < other))
            if len(hit):
                label = _spanning(len(fp), hit, at[hit], label)
    return label


def links_of(group: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (index, index) within the groups; ``group`` is sorted, fp within it."""
    n = len(fp)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    end = np.repeat(np.r_[first[1:], n], np.diff(np.r_[first, n])) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, n]) if n else np.zeros(0, np.int64)
    large = np.repeat(size > MAX_PAIRWISE, size) if n else np.zeros(0, bool)
    label, alive, step = np.arange(n), np.flatnonzero(~large), 1
    while len(alive := alive[alive + step < end[alive]]):
        hit = alive[np.bitwise_count(fp[alive] ^ fp[alive + step]) <= max_bits]
        if len(hit):
            label = _spanning(n, hit, hit + step, label)
        step += 1
    for lo, count in zip(first[size > MAX_PAIRWISE], size[size > MAX_PAIRWISE]):
        label[lo:lo + count] = lo + _group_links(fp[lo:lo + count], max_bits)
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def links(nodes: DataFrame, max_bits: int = 2, max_anchor: int = MAX_ANCHOR) -> DataFrame:
    """(a, b): links that span the components of the different fingerprints ``nodes`` (fp)."""
    spark = nodes.sparkSession
    placed = _at_anchors(nodes, max_bits)
    over = placed.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_anchor).select("anchor")
    over = materialize(over)
    if over.isEmpty():
        cells = placed.select("anchor", F.lit(0).cast("long").alias("sub"), "fp")
    else:
        cells = placed.join(over, "anchor", "left_anti").select("anchor", F.lit(0).cast("long").alias("sub"), "fp").union(
            _cut_again(placed.join(over, "anchor", "left_semi").select("anchor", "fp"), max_bits))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None                                        # the last group may go on in the next batch
        for pdf in batches:
            kept = pdf if kept is None else pd.concat([kept, pdf], ignore_index=True)
            last = (kept["anchor"] == kept["anchor"].iloc[-1]) & (kept["sub"] == kept["sub"].iloc[-1])
            if not last.all():
                yield compare(kept[~last])
                kept = kept[last]
        if kept is not None:
            yield compare(kept)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        anchor, sub = pdf["anchor"].to_numpy(), pdf["sub"].to_numpy()
        group = np.cumsum(np.r_[0, (anchor[1:] != anchor[:-1]) | (sub[1:] != sub[:-1])])
        fp = pdf["fp"].to_numpy(dtype=np.int64)
        a, b = links_of(group, fp.view(np.uint64), max_bits)
        return pd.DataFrame({"a": fp[a], "b": fp[b]}).drop_duplicates()

    # unsigned order within a group: the sign bit flipped
    order = F.col("fp").bitwiseXOR(F.lit(-(1 << 63)))
    return (cells.repartition(shuffle_partitions(spark), "anchor", "sub")
            .sortWithinPartitions("anchor", "sub", order)
            .mapInPandas(run, "a long, b long"))


def _roots(rows: DataFrame, max_bits: int, max_anchor: int) -> DataFrame:
    """(fp, first_id, root) of the different fingerprints: the smallest id and the group."""
    ids = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(links(ids, max_bits, max_anchor))
    return materialize(ids.join(roots, ids["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, max_anchor: int = MAX_ANCHOR) -> DataFrame:
    """doc_id, fp, component_id for every row: the smallest doc_id reachable over links."""
    rows = materialize(fingerprints(docs, shingle))
    labelled = _roots(rows, max_bits, max_anchor)
    first = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = labelled.join(first, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest id (a null id
    comes last; of equal ids, one text). A document is an id with its text: rows that share an id
    but not their group are decided apart, and rows that repeat both stay together. Column names
    that begin with ``_llm_`` are the operator's own."""
    rows = materialize(fingerprints(docs, shingle, keys=True))
    groups = _roots(rows, max_bits, MAX_ANCHOR).select("fp", "root")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk")
    stay = rows.join(groups, "fp").groupBy("root").agg(F.min(order).alias("best")).select(F.col("best.rk").alias("_llm_rk"))
    return docs.withColumn("_llm_rk", row_key()).join(stay, "_llm_rk", "left_semi").select(docs.columns)
