"""Nested control breaks against a row loop, for several chunk counts."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import breaks, scan
from ledgerflow.operators.breaks import Level, nested_breaks

NAMES = ["a", "b", "c", "d"]


def _rows(n=240, seed=3):
    rnd = random.Random(seed)
    rows, a, b = [], "x", 1
    for i in range(n):
        a = rnd.choice(["x", "y", None]) if rnd.random() < .06 else a
        b = rnd.choice([1, 2, None]) if rnd.random() < .15 else b
        rows.append((i, a, b, rnd.choice(["p", "q"]) if i > 90 else "p", rnd.choice([0, 1, 1, 1]), rnd.choice([None, 1, 2, -3])))
    return rows


def _loop(rows):
    """Runs by reading the rows in order, as a report does."""
    runs, starts, prev = {n: [] for n in NAMES}, {}, None
    for r in sorted(rows):
        keys = r[1:5]
        hit = next((i for i in range(4) if prev is None or prev[i] != keys[i]), None)
        starts[r[0]] = 0 if hit is None else hit + 1
        for i, n in enumerate(NAMES):
            if hit is not None and i >= hit:
                runs[n].append([])
            runs[n][-1].append(r)
        prev = keys
    out = {r[0]: [starts[r[0]]] for r in rows}
    for n in NAMES:
        for no, run in enumerate(runs[n], 1):
            seen = [r[5] for r in run if r[5] is not None]
            for r in run:
                out[r[0]] += [no, len(run), sum(seen) if seen else None]
    return out


def _got(spark, rows, chunks):
    df = spark.createDataFrame(rows, "i int, a string, b int, c string, d int, v int")
    g = nested_breaks(df, [(n, F.col(n)) for n in NAMES], ["i"], [("v", F.col("v"))], num_chunks=chunks)
    names = [x for n in NAMES for x in (f"{n}_run", f"{n}_rows", f"{n}_v")]
    return {r["i"]: [r["starts"], *[r[x] for x in names]] for r in g.collect()}


@pytest.mark.parametrize("chunks", [1, 4, 23])
def test_four_levels_equal_a_row_loop(spark, chunks):
    assert _got(spark, _rows(), chunks) == _loop(_rows())


def test_one_run_over_all_chunks_and_no_rows(spark):
    rows = [(i, "x", None, "p", 1, 1) for i in range(60)]
    assert _got(spark, rows, 9) == _loop(rows)
    assert _got(spark, [], 4) == {}


def test_an_outer_break_breaks_equal_inner_keys(spark):
    rows = [(1, "x", 1, "p", 1, 5), (2, "y", 1, "p", 1, 7), (3, "x", 1, "p", 1, 9)]
    got = _got(spark, rows, 2)
    assert [got[i][0] for i in (1, 2, 3)] == [1, 1, 1]
    assert [got[i][10:] for i in (1, 2, 3)] == [[1, 1, 5], [2, 1, 7], [3, 1, 9]]


def test_clashing_columns_are_refused(spark):
    with pytest.raises(ValueError, match="a_run"):
        nested_breaks(spark.createDataFrame([(1, 2)], "i int, a_run int"), [("a", F.col("i"))], ["i"])


def _accumulators(rows):
    """Running sums by a row loop: one in each (k, month), one that restarts after a 0 or missing value."""
    out, prev, month, mtd, acc = {}, None, None, None, None
    add = lambda a, b: b if a is None else a if b is None else a + b
    for i, k, m, x in sorted(rows):
        new = prev is None or prev[0] != k
        mtd = add(None if new or m != month else mtd, x)
        acc = add(None if new or not prev[1] else acc, x)
        out[i] = (None if new else prev[1], mtd, acc)
        prev, month = (k, x), m
    return out


@pytest.mark.parametrize("chunks, totals", [(1, False), (5, True), (8, False), (29, False)])
def test_resettable_accumulators_equal_a_row_loop(spark, chunks, totals):
    rnd = random.Random(chunks)
    rows, m = [], 1
    for i in range(200):
        m = m + 1 if rnd.random() < .1 else m
        rows.append((i, None if i < 20 else "hot" if i < 150 else "z", m, rnd.choice([None, 0, 2, 3, 5, -1, 7, 9])))
    df = spark.createDataFrame(rows, "i int, key string, month int, x int")
    levels = [Level("k", F.col("key"), totals=totals), Level("mon", F.col("month"), inside=["k"], running=True, totals=totals),
              Level("acc", after=F.coalesce("x", F.lit(0)) == 0, inside=["k"], running=True, totals=totals)]
    g = nested_breaks(df, levels, ["i"], [("x", F.col("x"))], [("prev_x", F.col("x"), "k")], num_chunks=chunks)
    assert ("acc_x" in g.columns) == totals
    assert {r.i: (r.prev_x, r.mon_x_running, r.acc_x_running) for r in g.collect()} == _accumulators(rows)


def test_runs_alone_need_no_sums(spark):
    df = spark.createDataFrame([(i, i // 7) for i in range(40)], "i int, v int")
    g = nested_breaks(df, [Level("a", F.col("v"), totals=False)], ["i"], num_chunks=6)
    assert sorted((r.i, r.starts, r.a_run) for r in g.collect()) == [(i, int(i % 7 == 0), i // 7 + 1) for i in range(40)]


def test_a_chunk_has_bounded_rows_and_nested_levels_one_sort(spark, monkeypatch):
    """A task holds one chunk, however many rows there are, and sorts it twice for any number of nested levels."""
    plans, chunks, frame = [], [], type(spark.range(0))
    checkpoint, chunk_by_range = frame.checkpoint, breaks.chunk_by_range
    monkeypatch.setattr(frame, "checkpoint", lambda self, *a, **b: plans.append(
        self._jdf.queryExecution().executedPlan().toString()) or checkpoint(self, *a, **b))
    monkeypatch.setattr(breaks, "chunk_by_range", lambda df, by, order, n=None, **b: chunks.append(n) or chunk_by_range(df, by, order, n, **b))
    monkeypatch.setattr(scan, "CHUNK_ROWS", 20)
    assert _got(spark, _rows(), None) == _loop(_rows())
    assert chunks == [12]
    assert plans[0].count("Sort [") == 2 and "hashpartitioning(_chunk" not in plans[0], plans[0]
