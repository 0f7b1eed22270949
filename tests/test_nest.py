from decimal import Decimal

from pyspark.sql import functions as F

from ledgerflow.operators.nest import master_detail, reconcile


def test_master_detail_counts(spark):
    m = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    d = spark.createDataFrame([(2, 10), (3, 30), (3, 10), (3, 20)], "k int, v int")
    rows = master_detail(m, d, "k", ["v"]).orderBy("k", "detail_no").collect()
    assert [(r.k, r.detail_no, r.detail_count, r.v) for r in rows] == [
        (1, None, 0, None), (2, 1, 1, 10), (3, 1, 3, 10), (3, 2, 3, 20), (3, 3, 3, 30)]


def test_reconcile_states(spark):
    h = spark.createDataFrame([(1, Decimal("10.00")), (2, Decimal("10.00")), (3, Decimal("10.00")), (4, Decimal("5.00"))],
                              "k int, declared decimal(18,2)")
    d = spark.createDataFrame([(1, Decimal("4.00")), (1, Decimal("6.00")), (2, Decimal("9.99")), (3, Decimal("10.01"))],
                              "k int, amt decimal(18,2)")
    got = {r.k: r.status for r in reconcile(h, d, "k", "declared", F.col("amt")).collect()}
    assert got == {1: "Cuadrada", 2: "Revisar", 3: "Revisar"}          # no details: not listed


def test_exclusive_rows_equals_not_exists(spark):
    from ledgerflow.operators.nest import exclusive_rows
    rows = [(1, 1, 10), (1, 1, 10), (1, 2, 10), (1, 2, 11), (2, 1, None), (2, 1, 12), (3, 3, None), (3, 3, None),
            (4, 4, 7), (4, 4, 8), (4, 4, 9)]
    df = spark.createDataFrame(rows, "o int, p int, s int")
    df.createOrReplaceTempView("excl_fixture")
    brute = spark.sql("""SELECT * FROM excl_fixture a WHERE NOT EXISTS (
        SELECT 1 FROM excl_fixture b WHERE b.o = a.o AND b.p = a.p AND b.s <> a.s)""")
    got = exclusive_rows(df, ["o", "p"], "s").select("o", "p", "s")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got.collect(), key=key) == sorted(brute.collect(), key=key)
