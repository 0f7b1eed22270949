"""Chunked scans must equal plain windows, also when one key spans many chunks."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerflow.operators import scan


def _rows(seed=7):
    rnd = random.Random(seed)
    rows = []
    i = 0
    for key, n in (("hot", 240), ("a", 5), ("b", 1), ("c", 30), (None, 4)):
        for _ in range(n):
            val = rnd.choice([None, 0, 1, 2, 5, -3]) if key != "c" else rnd.randint(-5, 5)
            rows.append((key, rnd.randint(0, 40), i, val))
            i += 1
    return rows


def _df(spark):
    return spark.createDataFrame(_rows(), "k string, d int, id int, v int")


def test_cumsum_rows_and_range_match_windows(spark):
    df = _df(spark)
    c = scan.chunk_by_range(df, ["k"], ["d", "id"], num_chunks=13)
    got = scan.cumsum(c, F.col("v"), ["k"], ["d", "id"], "run_rows").drop(scan.CHUNK)
    w = Window.partitionBy("k").orderBy("d", "id").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.select("id", F.sum("v").over(w).alias("run_rows"))
    assert sorted(got.select("id", "run_rows").collect()) == sorted(exp.collect())
    # RANGE frame: chunked on exactly (by, order) so peers share a chunk
    c = scan.chunk_by_range(df, ["k"], ["d"], num_chunks=13)
    got = scan.cumsum(c, F.col("v"), ["k"], ["d"], "run_range", frame="range").drop(scan.CHUNK)
    exp = df.select("id", F.sum("v").over(Window.partitionBy("k").orderBy("d")).alias("run_range"))
    assert sorted(got.select("id", "run_range").collect()) == sorted(exp.collect())


def test_lag_and_last_non_null_match_windows(spark):
    df = _df(spark)
    c = scan.chunk_by_range(df, ["k"], ["d", "id"], num_chunks=17)
    got = scan.lag(c, F.col("v"), ["k"], ["d", "id"], "prev", first_flag="first")
    got = scan.last_non_null(got, F.col("v"), ["k"], ["d", "id"], "lnn").drop(scan.CHUNK)
    w = Window.partitionBy("k").orderBy("d", "id")
    exp = df.select("id", F.lag("v").over(w).alias("prev"), (F.row_number().over(w) == 1).alias("first"),
                    F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("lnn"))
    assert sorted(got.select("id", "prev", "first", "lnn").collect()) == sorted(exp.collect())


def test_global_order_without_key(spark):
    df = _df(spark)
    c = scan.chunk_by_range(df, [], ["id"], num_chunks=9)
    got = scan.cumsum(c, F.lit(1), [], ["id"], "pos").drop(scan.CHUNK)
    assert sorted((r.id, r.pos) for r in got.collect()) == [(i, i + 1) for i in range(df.count())]


def test_result_does_not_depend_on_chunk_count(spark):
    df = _df(spark)
    outs = []
    for n in (1, 4, 31):
        c = scan.chunk_by_range(df, ["k"], ["d", "id"], num_chunks=n)
        outs.append(sorted(scan.cumsum(c, F.col("v"), ["k"], ["d", "id"], "r").select("id", "r").collect()))
    assert outs[0] == outs[1] == outs[2]


def test_total_and_first_match_windows(spark):
    df = _df(spark)
    w = Window.partitionBy("k")
    exp = df.select("id", F.sum("v").over(w).alias("t"), F.count(F.lit(1)).over(w).alias("n"),
                    F.first("v").over(w.orderBy("d", "id")).alias("f"))
    for n in (1, 5, 31):
        c = scan.chunk_by_range(df, ["k"], ["d", "id"], num_chunks=n)
        got = scan.scan_all(c, ["k"], ["d", "id"], [("t", "total", F.col("v")), ("n", "total", F.lit(1)), ("f", "first", F.col("v"))])
        assert sorted(map(str, got.select("id", "t", "n", "f").collect())) == sorted(map(str, exp.collect()))
    none = scan.scan_all(scan.chunk_by_range(df.limit(0), [], ["id"]), [], ["id"], [("t", "total", F.col("v")), ("f", "first", F.col("v"))])
    assert none.collect() == []


def test_row_numbers_over_the_whole_frame(spark):
    df = _df(spark)
    w = Window.orderBy("d", "id")
    exp = [tuple(r) for r in df.select("id", "k", F.row_number().over(w).alias("pos")).orderBy("pos").collect()]
    for n in (1, 5, 31):
        got = scan.number_rows(df, ["d", "id"], "pos", ["id", "k"], n)
        assert [tuple(r) for r in got.collect()] == exp                     # sorted, too
    twice = scan.number_rows(df.select("d").union(df.select("d")), ["d"], "pos", ["d"], 7).collect()
    assert [r.pos for r in twice] == list(range(1, 2 * len(exp) + 1)) and [r.d for r in twice] == sorted(r.d for r in twice)
    assert scan.number_rows(df.limit(0), ["d"], "pos", ["d"]).collect() == []


def test_packing_list_moves_its_rows_once(spark, monkeypatch, tmp_path):
    """After the joins the wide rows are exchanged once: to be sorted and numbered; chunks have bounded rows."""
    from ledgerflow.plans import REGISTRY

    day = F.lit("1996-02-03").cast("timestamp")
    one = F.lit(1).cast("double")
    tables = {
        "nation": spark.range(2).select(F.col("id").cast("int").alias("n_nationkey"), F.concat(F.lit("N"), "id").alias("n_name")),
        "customer": spark.range(3).select(F.col("id").alias("c_custkey"), F.concat(F.lit("C"), "id").alias("c_name"), (F.col("id") % 2).cast("int").alias("c_nationkey")),
        "supplier": spark.range(3).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("S"), "id").alias("s_name"), F.lit(1).alias("s_nationkey")),
        "part": spark.range(4).select(F.col("id").alias("p_partkey"), F.concat(F.lit("P"), "id").alias("p_name")),
        "orders": spark.range(40).select(F.col("id").alias("o_orderkey"), (F.col("id") % 3).alias("o_custkey"), day.alias("o_orderdate")),
        "lineitem": spark.range(120).select(
            (F.col("id") % 41).alias("l_orderkey"), (F.col("id") % 5).alias("l_partkey"), (F.col("id") % 3).alias("l_suppkey"),
            F.col("id").cast("int").alias("l_linenumber"), F.col("id").cast("double").alias("l_quantity"), one.alias("l_extendedprice"),
            one.alias("l_discount"), one.alias("l_tax"), F.lit("A").alias("l_returnflag"), F.lit("O").alias("l_linestatus"), day.alias("l_shipdate")),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    chunks, number_rows = [], getattr(scan, "number_rows", None)
    monkeypatch.setattr(scan, "CHUNK_ROWS", 10, raising=False)
    monkeypatch.setattr(scan, "number_rows", lambda df, order, out, keep, n: chunks.append(n) or number_rows(df, order, out, keep, n), raising=False)
    got = REGISTRY["packing_list"].build(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan, plan
    kept = sorted((i % 41, i) for i in range(120) if i % 41 < 40 and i % 5 < 4)
    assert [(r.l_orderkey, int(r.l_quantity), r.product) for r in got.collect()] == [
        (o, i, f"{n}. P{i % 5}") for n, (o, i) in enumerate(kept, 1)]
    assert chunks == [12]
