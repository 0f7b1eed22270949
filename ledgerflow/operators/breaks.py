"""Nested control breaks: report groups inside report groups over ordered rows.

A group starts a new run where its key differs from the row before (or, for a resettable
accumulator, after a row that meets a condition), and a break of an outer group also breaks every
group inside it, even if their own keys stay the same. ``nested_breaks`` gives each row the run
number of every level, the rows and totals of those runs (a group's footer values, on each of its
rows), running sums inside them, values of the row before, and the outermost level that starts.

All levels come from one pass: windows per chunk of the order, then one summary with one row a
chunk. Only the first and the last run of a chunk can cross its edges, so their totals are added
up in the summary, which is bounded by chunks x levels. A run of any length is spread over its chunks.
A chunk is a partition of its own, with a bounded number of rows at any size of the report.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ledgerflow.operators.scan import CHUNK, chunk_by_range, plan_chunks
from ledgerflow.session import ensure_checkpoint_dir

START = "starts"


@dataclass(frozen=True)
class Level:
    """One report group. It breaks where ``key`` changes, after each row where ``after`` is true,
    and with every level that it lies ``inside`` (by name; None: all levels listed before it).
    ``running`` adds the running sums inside its runs, ``totals=False`` leaves out its rows and
    totals: levels that only restart a sum need none, and a level without both needs no sort."""

    name: str
    key: Column | None = None
    after: Column | None = None
    inside: Sequence[str] | None = None
    running: bool = False
    totals: bool = True


def _breaks(level: Level, levels: Sequence[Level], prev: Column, cur: Column) -> Column:
    """The level starts at ``cur``, the row after ``prev`` (NULL keys equal each other)."""
    chain = [x for x in levels[:levels.index(level)] if level.inside is None or x.name in level.inside] + [level]
    conds = [~prev.getField(f"k_{x.name}").eqNullSafe(cur.getField(f"k_{x.name}")) for x in chain if x.key is not None]
    conds += [F.coalesce(prev.getField(f"a_{x.name}"), F.lit(False)) for x in chain if x.after is not None]
    return reduce(lambda a, b: a | b, conds)


def _first(starts: Sequence[Column]) -> Column:
    """1-based position of the outermost level that starts, 0 if none does."""
    return F.coalesce(*[F.when(s, F.lit(i + 1)) for i, s in enumerate(starts)], F.lit(0))


def _run_window(levels: Sequence[Level], i: int, order: Sequence[str]) -> WindowSpec:
    """The rows of a level's run in a chunk, in order. Run numbers rise with the order, so those of
    other levels may stand in the sort: levels that lie inside all levels before them share one."""
    used = [k for k, x in enumerate(levels) if k == i or x.totals or x.running]
    outer = [k for k in used if k < i and (levels[i].inside is None or levels[k].name in levels[i].inside)]
    rest = [k for k in used if k != i and k not in outer]
    return Window.partitionBy(CHUNK, *[f"_r{k}" for k in [*outer, i]]).orderBy(*[f"_r{k}" for k in rest], *order)


def _plus(a: Column, b: Column) -> Column:
    """Sum of two sums, NULL only if both are."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def nested_breaks(df: DataFrame, levels: Sequence[Level | tuple[str, Column]], order: Sequence[str],
                  measures: Sequence[tuple[str, Column]] = (), previous: Sequence[tuple[str, Column, str]] = (),
                  num_chunks: int | None = None) -> DataFrame:
    """Add the runs of nested groups to the rows of ``df``.

    ``levels``: from the outermost to the innermost (``(name, key)`` is short for a ``Level`` with
    that key); ``order``: columns that put the rows in report order, unique together. For each
    level the result has ``<name>_run`` (1, 2, ... over the whole report), ``<name>_rows`` and, for
    each ``(measure, value)``, ``<name>_<measure>`` (the run's sum; NULL if all its values are) and
    for running levels ``<name>_<measure>_running``. ``previous``: ``(column, value, level)`` gives
    the value of the row before in the same run of the level, NULL at its first row. ``starts`` is
    the position of the outermost level that starts at the row (1 the outermost, 0 none). NULL keys
    are keys like any other and equal each other. An empty frame gives an empty frame. Without
    ``num_chunks`` the rows are counted first.
    """
    ensure_checkpoint_dir(df.sparkSession)
    levels = [x if isinstance(x, Level) else Level(*x) for x in levels]
    at_level = {x.name: i for i, x in enumerate(levels)}
    sums = [("rows", F.lit(1).cast("long")), *measures]
    src = df.columns
    new = [f"{x.name}_{m}" for x in levels for m in ["run", *[n for n, _ in sums if x.totals]]] + [START] + [p[0] for p in previous]
    new += [f"{x.name}_{m}_running" for x in levels if x.running for m, _ in measures]
    if clash := sorted(set(new) & set(src)):
        raise ValueError(f"columns {clash} exist already")
    fields = [x.key.alias(f"k_{x.name}") for x in levels if x.key is not None]
    fields += [x.after.alias(f"a_{x.name}") for x in levels if x.after is not None]
    fields += [v.alias(f"p_{i}") for i, (_, v, _) in enumerate(previous)]
    d = df.withColumn("_keys", F.struct(*fields))
    for m, (_, value) in enumerate(sums):
        d = d.withColumn(f"_m{m}", value)
    n = num_chunks or plan_chunks(df.sparkSession, df.count())
    d = chunk_by_range(d, [], order, n, checkpoint=False).repartitionById(n, CHUNK)
    w = Window.partitionBy(CHUNK).orderBy(*order)
    d = d.withColumn("_prev", F.lag("_keys").over(w)).withColumn("_end", F.lead(F.lit(1)).over(w).isNull())
    d = d.withColumn("_begin", F.col("_prev").isNull())
    for i, x in enumerate(levels):
        d = d.withColumn(f"_b{i}", ~F.col("_begin") & _breaks(x, levels, F.col("_prev"), F.col("_keys")))
    for i in range(len(levels)):
        d = d.withColumn(f"_r{i}", F.sum(F.col(f"_b{i}").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    for i, (_, _, name) in enumerate(previous):
        d = d.withColumn(f"_p{i}", F.when(~F.col(f"_b{at_level[name]}"), F.col("_prev").getField(f"p_{i}")))
    d = d.withColumn("_keys", F.when(F.col("_begin") | F.col("_end"), F.col("_keys"))).drop("_prev")     # for the summary
    for i, x in enumerate(levels):
        run = _run_window(levels, i, order)
        whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        for m in range(len(sums)):
            if x.totals:
                d = d.withColumn(f"_t{i}_{m}", F.sum(f"_m{m}").over(whole))
            if x.running and m:
                d = d.withColumn(f"_u{i}_{m}", F.sum(f"_m{m}").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.drop(*[f"_m{m}" for m in range(len(sums))])
    d = d.checkpoint(eager=True)                # read for the rows and for the summary
    j = d.join(F.broadcast(_summary(d, levels, len(sums), [at_level[p[2]] for p in previous])), CHUNK, "left")
    out = [F.when(F.col("_begin"), F.col("_brk")).otherwise(_first([F.col(f"_b{i}") for i in range(len(levels))]))
            .cast("int").alias(START)]
    for i, x in enumerate(levels):
        r = F.col(f"_r{i}")
        out.append((F.col(f"_off{i}") + r).alias(f"{x.name}_run"))
        for m, (label, _) in enumerate(sums):
            if x.totals:
                out.append(F.when(r == 0, F.col(f"_f{i}.s{m}")).when(r == F.col(f"_last{i}"), F.col(f"_l{i}.s{m}"))
                            .otherwise(F.col(f"_t{i}_{m}")).alias(f"{x.name}_{label}"))
            if x.running and m:
                local = F.col(f"_u{i}_{m}")
                out.append(F.when(r == 0, _plus(F.col(f"_f{i}.c{m}"), local)).otherwise(local).alias(f"{x.name}_{label}_running"))
    out += [F.when(F.col("_begin"), F.col(f"_q{i}")).otherwise(F.col(f"_p{i}")).alias(p[0]) for i, p in enumerate(previous)]
    return j.select(*src, *out)


def _summary(d: DataFrame, levels: Sequence[Level], n_sums: int, previous: Sequence[int]) -> DataFrame:
    """One row a chunk: what its first row starts, the runs before it, the whole totals of its
    first and its last run of every level, and what the first run has summed in earlier chunks."""
    every = range(len(levels))
    summed = [i for i in every if levels[i].totals or levels[i].running]
    local = {(i, m): f"_t{i}_{m}" if levels[i].totals else f"_u{i}_{m}" for i in summed for m in range(n_sums) if m or levels[i].totals}
    edge = F.struct("_keys", *[f"_r{i}" for i in every], *local.values())
    per = d.where(F.col("_begin") | F.col("_end")).groupBy(CHUNK).agg(
        F.max(F.when(F.col("_begin"), edge)).alias("f"), F.max(F.when(F.col("_end"), edge)).alias("l"))
    w = Window.orderBy(CHUNK)
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("_prev", F.lag("l").over(w).getField("_keys"))
    for i, x in enumerate(levels):
        per = per.withColumn(f"_n{i}", F.col("_prev").isNull() | _breaks(x, levels, F.col("_prev"), F.col("f._keys")))
    per = per.withColumn("_brk", _first([F.col(f"_n{i}") for i in every]))
    for i in every:
        per = per.withColumn(f"_off{i}", F.sum(F.col(f"_n{i}").cast("long")).over(upto)
                             + F.coalesce(F.sum(F.col(f"l._r{i}")).over(before), F.lit(0)))
    entries = []
    for i in summed:
        for side in "fl":
            run = F.col(f"_off{i}") + F.col(f"{side}._r{i}")
            if levels[i].totals:
                sums = [F.col(f"{side}.{local[i, m]}").alias(f"s{m}") for m in range(n_sums)]
            else:       # at the last row the running sum is the run's; later chunks need no other run
                sums = [F.lit(None).cast("long").alias("s0")]
                for m in range(1, n_sums):
                    at_end = F.col(f"l.{local[i, m]}")
                    sums.append((at_end if side == "l" else F.when(F.col(f"l._r{i}") == 0, at_end)).alias(f"s{m}"))
            entry = F.struct(F.lit(i).alias("level"), F.lit(side).alias("side"), run.alias("run"), *sums)
            # A chunk of one run has it at both edges: counted once, found from the first edge.
            entries.append(entry if side == "f" else F.when(F.col(f"l._r{i}") > 0, entry))
    keep = per.select(CHUNK, "_brk", *[c for i in every for c in (F.col(f"_off{i}"), F.col(f"l._r{i}").alias(f"_last{i}"))],
                      *[F.when(~F.col(f"_n{lv}"), F.col("_prev").getField(f"p_{i}")).alias(f"_q{i}") for i, lv in enumerate(previous)])
    if not summed:
        return keep
    e = per.select(CHUNK, F.explode(F.array(*entries)).alias("e")).where("e IS NOT NULL").select(CHUNK, "e.*")
    run = Window.partitionBy("level", "run").orderBy(CHUNK)
    whole, earlier = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), run.rowsBetween(Window.unboundedPreceding, -1)
    cells = [c for m in range(n_sums) for c in (F.sum(f"s{m}").over(whole).alias(f"s{m}"), F.sum(f"s{m}").over(earlier).alias(f"c{m}"))]
    e = e.select(CHUNK, "level", "side", F.struct(*cells).alias("t"))
    totals = e.groupBy(CHUNK).agg(*[F.max(F.when((F.col("level") == i) & (F.col("side") == side), F.col("t"))).alias(f"_{side}{i}")
                                    for i in summed for side in "fl"])
    return keep.join(F.broadcast(totals), CHUNK)
