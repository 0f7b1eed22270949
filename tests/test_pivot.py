import pytest
from pyspark.sql import functions as F

from ledgerflow.operators.pivot import category_ranks, crosstab_totals, query_pivot, rollup_sets, wide_pivot


def test_wide_pivot_cells(spark):
    df = spark.createDataFrame(
        [(1, "A", 2.0, 1), (1, "A", 3.0, 2), (1, "Z", 9.0, 3), (2, "B", 4.0, 1), (None, "A", 1.0, 1)],
        "id int, cat string, v double, seq int")
    cats = [("B", "b"), ("A", "a"), (("A", "B"), "ab"), ("C", "c")]   # declared order, not data order
    got = {r.id: r for r in wide_pivot(df, ["id"], "cat", cats, "v").collect()}
    assert (got[1].a, got[1].b, got[1].ab, got[1].c) == (5.0, 0, 5.0, 0)     # two rows in one cell summed
    assert (got[2].a, got[2].b, got[2].ab) == (0, 4.0, 4.0)
    assert got[None].a == 1.0                                             # NULL id is its own row
    last = {r.id: r for r in wide_pivot(df, ["id"], "cat", [("A", "a")], "v", agg="last", order=["seq"], fill=None).collect()}
    assert last[1].a == 3.0 and last[2].a is None


def test_rollup_sets_and_totals(spark):
    assert rollup_sets(["r1", "r2"], ["c1"]) == [["r1", "r2", "c1"], ["r1", "r2"], ["r1", "c1"], ["r1"], ["c1"], []]
    df = spark.createDataFrame([("x", "p", "m", 1), ("x", "q", "m", 2), ("y", "p", "n", 4)],
                               "r1 string, r2 string, c1 string, v int")
    t = crosstab_totals(df, ["r1", "r2"], ["c1"], [F.sum("v").alias("v")])
    rows = t.collect()
    grand = [r.v for r in rows if r.gid == 7]
    leaves = [r.v for r in rows if r.gid == 0]
    assert grand == [7] and sum(leaves) == 7


def test_crosstab_columns_come_from_the_category_relation(spark):
    df = spark.createDataFrame([(1, "diesel", 2), (1, "diesel", 3), (1, "super", 1), (2, None, 9), (3, "flete", 4), (None, "super", 6)],
                               "id int, cat string, v int")
    cats = [("super", 8), ("diesel", 10), (None, 1), ("super", 11)]
    get = lambda rows, **kw: query_pivot(df, ["id"], "cat", F.col("v"), spark.createDataFrame(rows, "cat string, pos int"),
                                         order=["pos"], **kw)
    got = get(cats)
    assert got.columns == ["id", "super", "diesel"]                      # ranked by the relation, a repeat counts once
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 1, 5), (2, 0, 0), (3, 0, 0), (None, 6, 0)], key=str)
    more = get([*cats, ("flete", 9)])                                    # a new category is a new column
    assert more.columns == ["id", "super", "flete", "diesel"]
    assert {r["id"]: r["flete"] for r in more.collect()} == {1: 0, 2: 0, 3: 4, None: 0}
    assert {r["id"]: r["diesel"] for r in get(cats, fill=None).collect()} == {1: 5, 2: None, 3: None, None: None}


def test_crosstab_category_bounds(spark):
    df = spark.createDataFrame([(1, "a", 2), (2, "a", 3)], "id int, cat string, v int")
    cats = lambda *rows: spark.createDataFrame([(r,) for r in rows], "cat string")
    assert sorted(query_pivot(df, ["id"], "cat", F.col("v"), cats()).collect()) == [(1,), (2,)]
    assert query_pivot(df.limit(0), ["id"], "cat", F.col("v"), cats("a")).collect() == []
    assert category_ranks(cats("b", "a", "b"), "cat") == ["a", "b"]
    with pytest.raises(ValueError, match="over 2 categories"):
        query_pivot(df, ["id"], "cat", F.col("v"), cats("a", "b", "c"), max_categories=2)
    with pytest.raises(ValueError, match="named twice"):
        query_pivot(df, ["id"], "cat", F.col("v"), cats("a", "A"))


@pytest.mark.parametrize("n, aggregates", [(6, 2), (40, 2)])
def test_crosstab_sums_each_cell_once(spark, n, aggregates):
    """Few categories: one aggregation by key. Many: one by cell, and the cells of a key are listed."""
    df = spark.range(0, 3000, 1, 4).select((F.col("id") % 97).alias("k"), F.when(F.col("id") % 11 > 0, F.concat(F.lit("c"), F.col("id") % (n + 3))).alias("cat"),
                                           F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"))
    cats = spark.range(n).select(F.concat(F.lit("c"), "id").alias("cat"), "id")
    for fill in (0, None):
        got = query_pivot(df, ["k"], "cat", F.col("v"), cats, order=["id"], fill=fill)
        assert got.columns == ["k", *[f"c{i}" for i in range(n)]]
        exp = wide_pivot(df, ["k"], "cat", [(f"c{i}", f"c{i}") for i in range(n)], "v", fill=fill)
        assert sorted(map(str, got.collect())) == sorted(map(str, exp.collect()))
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "pivotfirst" not in plan and plan.count("HashAggregate(keys=[k#") - plan.count("ObjectHashAggregate(keys=[k#") == aggregates, plan
