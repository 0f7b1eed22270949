"""Mixing sources to target weights by temperature.

A source with the share p of all tokens gets the weight p^a / sum p^a. The exponent a (1: the
natural mix, 0: equal weights) is found by bisection to ``STEP``: the smallest at which no
source is read more than ``max_repeats`` times, or the largest at which the mix has an entropy
of at least ``min_entropy``. Each round measures ``POINTS`` exponents in one aggregate over the
table of sources, so nothing but those numbers reaches the driver. The budget is such that the
largest source is read exactly once: no document is lost, smaller sources are read again.

A source's budget is realised as block permutations: every block holds all its documents in an
order given by a hash of (seed, block, document); the last block is cut where the budget ends.
Starts within a block come from the sums of the hash buckets before and a window inside
the bucket, so a source with a third of all rows is spread over 4,096 buckets.
Only built-in functions are used.

Tokens are runs of non-white characters. Defined results: null text is the empty text (no
tokens); a null source is a source of its own; sources without tokens get one block; rows that
repeat an id and its text are one document with ``copies`` and stay together; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import materialize, row_key, text_of

STEP = 2.0 ** -24           # of the exponent
POINTS = 15                 # exponents measured in one round
BUCKET_DIGITS = 3           # hex digits that name a bucket: 4,096 of them in a block
WORD = r"[^\x20\x09-\x0D]+"


def source_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, rk (the document), source, key (the source, null too), tokens, copies."""
    key = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("source")))
    each = docs.select("doc_id", row_key().alias("rk"), "source", key.alias("key"),
                       F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("tokens"))
    return each.groupBy("doc_id", "rk", "source", "key", "tokens").agg(F.count(F.lit(1)).alias("copies"))


def _measure(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy, repeats of the source that is read most often) at each exponent."""
    columns = []
    for i, a in enumerate(exponents):
        w = F.pow("share", F.lit(a))
        columns += [F.sum(w).alias(f"z{i}"), F.sum(w * F.log(w)).alias(f"s{i}"),
                    F.max(F.pow(F.col("share") / F.col("largest"), F.lit(a - 1))).alias(f"r{i}")]
    row = sources.agg(*columns).first()
    out = []
    for i in range(len(exponents)):
        z, s, r = row[f"z{i}"], row[f"s{i}"], row[f"r{i}"]
        out.append((0.0, 1.0) if z is None else (math.log(z) - s / z, r))
    return out


def find_exponent(sources: DataFrame, max_repeats: float | None = None, min_entropy: float | None = None) -> float:
    """``sources`` has share and largest (the largest share) of every source with tokens."""
    if (max_repeats is None) == (min_entropy is None):
        raise ValueError("give either max_repeats or min_entropy")

    def good(entropy: float, repeats: float) -> bool:         # holds from the answer on, or up to it
        return repeats <= max_repeats if max_repeats is not None else entropy < min_entropy

    low, high = 0.0, 1.0                                     # not good at low, good at high
    if good(*_measure(sources, [0.0])[0]):
        return 0.0
    if not good(*_measure(sources, [1.0])[0]):
        return 1.0
    while high - low > STEP:
        step = max(STEP, (high - low) / (POINTS + 1))
        inner = [low + step * i for i in range(1, POINTS + 1) if low + step * i < high]
        bad = [a for a, m in zip(inner, _measure(sources, inner)) if not good(*m)]
        fine = [a for a in inner if a not in bad]
        low, high = max([low, *bad]), min([high, *fine])
    return high if max_repeats is not None else low


def weights(tokens: DataFrame, max_repeats: float | None = None, min_entropy: float | None = None) -> DataFrame:
    """key, total (tokens), weight, budget of every source."""
    total = F.col("total")
    per = materialize(tokens.groupBy("key").agg(F.sum(F.col("tokens") * F.col("copies")).alias("total")))
    every, largest = per.agg(F.sum("total"), F.max("total")).first()
    if not every:
        return per.select("key", "total", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"))
    sources = per.filter("total > 0").select((total / F.lit(every)).alias("share"), F.lit(largest / every).alias("largest"))
    a = find_exponent(sources, max_repeats, min_entropy)
    z = per.filter("total > 0").agg(F.sum(F.pow(total / F.lit(every), F.lit(a)))).first()[0]
    weight = F.when(total > 0, F.pow(total / F.lit(every), F.lit(a)) / F.lit(z)).otherwise(0.0)
    budget = F.round(F.pow(total.cast("double"), F.lit(a)) * F.pow(F.lit(float(largest)), F.lit(1 - a))).cast("long")
    return per.select("key", "total", weight.alias("weight"), F.when(total > 0, budget).otherwise(0).cast("long").alias("budget"))


def mix(docs: DataFrame, max_repeats: float | None = 2.0, min_entropy: float | None = None, seed: int = 0) -> DataFrame:
    """One row per document and block in which it is read: doc_id, rk, source, tokens, copies,
    weight, block, start (tokens before it in the block), mix_key (0 to 1: reading all sources
    in this order keeps the weights)."""
    tokens = materialize(source_tokens(docs))
    plan = weights(tokens, max_repeats, min_entropy)
    blocks = F.when(F.col("total") > 0, F.expr("(budget + total - 1) div total - 1")).otherwise(0).cast("int")
    # the second key makes both join sides plain exchanges (a hot source can be split) and has the
    # windows below dealt by bucket and not by source
    tokens, plan = tokens.withColumn("key_length", F.length("key")), plan.withColumn("key_length", F.length("key"))
    own = (tokens.join(plan, ["key", "key_length"]).withColumn("block", F.explode(F.sequence(F.lit(0), blocks)))
           .withColumn("order", F.md5(F.concat_ws("|", F.lit(str(seed)), "block", F.lower(F.hex("rk"))).cast("binary")))
           .withColumn("bucket", F.substring("order", 1, BUCKET_DIGITS)))
    length = F.col("tokens") * F.col("copies")
    sums = own.groupBy("key", "block", "bucket").agg(F.sum(length).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("key", "block").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("key", "block", "bucket", before.alias("before"))
    inside = F.coalesce(F.sum(length).over(Window.partitionBy("key", "block", "bucket").orderBy("order", "doc_id").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    placed = own.withColumn("inside", inside).join(sums, ["key", "block", "bucket"]).withColumn("start", F.col("before") + F.col("inside"))
    read = F.col("block") * F.col("total") + F.col("start")
    whole = (F.col("block") + 1) * F.col("total") <= F.col("budget")
    return (placed.filter((F.col("total") == 0) | whole | (read < F.col("budget")))
            .select("doc_id", "rk", "source", "tokens", "copies", "weight", "block", "start",
                    F.when(F.col("budget") > 0, read / F.col("budget")).otherwise(0.0).alias("mix_key")))


def mixed_rows(docs: DataFrame, max_repeats: float | None = 2.0, min_entropy: float | None = None, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix reads it."""
    times = mix(docs, max_repeats, min_entropy, seed).groupBy("rk").agg(F.count(F.lit(1)).cast("int").alias("_llm_times"))
    return (docs.withColumn("_llm_rk", row_key()).join(times.withColumnRenamed("rk", "_llm_rk"), "_llm_rk")
            .withColumn("_llm_time", F.explode(F.sequence(F.lit(1), F.col("_llm_times"))))
            .drop("_llm_rk", "_llm_times", "_llm_time"))
