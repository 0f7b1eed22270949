"""Inputs that the test tables do not hold: fractional and zero quantities, NULL keys, no lists, large amounts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerflow.functions.predicates import in_periods, in_years
from ledgerflow.functions.words import amount_in_words
from ledgerflow.operators.nest import exclusive_rows
from ledgerflow.plans import REGISTRY


def test_exclusive_rows_keep_null_keys(spark):
    df = spark.createDataFrame([(1, None, 5), (None, 2, 6), (1, 1, 7), (2, 2, 1), (2, 2, 2)], "a int, b int, o int")
    assert sorted(r["o"] for r in exclusive_rows(df, ["a", "b"], "o").collect()) == [5, 6, 7]


def test_no_list_is_no_filter(spark):
    df = spark.sql("SELECT DATE '1998-05-03' AS d")
    for values in (None, []):
        assert df.where(in_periods("d", values) & in_years("d", values)).count() == 1


def test_large_amounts_read_dashes(spark):
    values = ["999999999.99", "1000000000.00", "10000000000.00", "-10000000000.00", "1" * 30]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(amount_in_words(F.col("v").cast("decimal(38,2)"))).collect()]
    assert got[0].startswith("novecientos") and got[1:] == ["---"] * 4


def test_order_pivots_with_fractional_and_zero_quantities(spark, tmp_path):
    lines = [(1, 1, 2.5, 5967.10), (2, 1, 0.5, 10.0), (3, 1, 0.0, 7.0), (4, 1, 3.0, 10.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double").selectExpr(
        "*", "'A' AS l_returnflag", "0.0D AS l_tax").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, "X")], "p_partkey long, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    got = {r["l_orderkey"]: r["price_a"] for r in REGISTRY["order_pivots"].build(spark, str(tmp_path)).collect()}
    assert got == {1: 2386.84, 2: 20.0, 3: 0.0, 4: 3.33}


def _tables(spark, root, lines, parts=((1, "X"), (2, "Y"))):
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_returnflag string, day string"
                          ).selectExpr("*", "CAST(day AS TIMESTAMP) AS l_shipdate", "1 AS l_linenumber", "1L AS l_suppkey",
                                       "0.0D AS l_discount", "0.0D AS l_tax", "'O' AS l_linestatus"
                                       ).drop("day").write.parquet(str(root / "lineitem.parquet"))
    spark.createDataFrame(parts, "p_partkey long, p_type string").write.parquet(str(root / "part.parquet"))


def test_spine_covers_all_dates(spark, tmp_path):
    _tables(spark, tmp_path, [(1, 1, 1.0, 10.0, "N", "1980-03-04"), (2, 1, 1.0, 4.0, "R", "2030-01-31"), (3, 2, 1.0, 1.0, "N", "2030-01-01")])
    rows = REGISTRY["month_spine_balance"].build(spark, str(tmp_path)).collect()
    x = {(r["yr"], r["mon"]): (r["movement"], r["balance"]) for r in rows if r["p_type"] == "X"}
    assert len(rows) == 2 * 599 and x[1980, 3] == (10.0, 10.0) and x[2029, 12] == (0.0, 10.0) and x[2030, 1] == (-4.0, 6.0)
    assert REGISTRY["account_calendar_gaps"].build(spark, str(tmp_path)).agg(F.sum("n_lines")).first()[0] == 3
    late = REGISTRY["month_spine_balance"].build(spark, str(tmp_path), start=dt.date(2030, 1, 1)).where("p_type = 'X'").collect()
    assert [(r["movement"], r["balance"]) for r in late] == [(-4.0, 6.0)]


def test_spine_without_dates(spark, tmp_path):
    _tables(spark, tmp_path, [(1, 1, 1.0, 10.0, "N", None)])
    for name in ("month_spine_balance", "account_calendar_gaps"):
        assert REGISTRY[name].build(spark, str(tmp_path)).count() == 0


def test_fuel_metrics_of_one_day(spark, tmp_path):
    _tables(spark, tmp_path, [(1, 1, 4.0, 100.0, "N", "1998-08-02"), (2, 1, 9.0, 500.0, "N", "1998-08-04"),
                              (3, 1, 21.0, 5.0, "N", "1998-08-03 23:59:59"), (4, 2, 0.0, 7.0, "N", "1998-08-02")])
    got = {(r["p_type"], r["metric"]): r["value"] for r in REGISTRY["metric_stack"].build(spark, str(tmp_path)).collect()}
    assert got["X", "gallons"] == 4.0 and got["X", "next_day_barrels"] == 0.5 and got["X", "price_with_tax"] == 28.5
    assert got["X", "price_usd_cents"] == round((25 + 0.5 / 1.12) / 7.8 * 100, 5)
    assert got["Y", "gallons"] == 0.0 and got["Y", "price_with_tax"] is None and got["Y", "price_usd_cents"] is None


def test_month_value_runs_over_months(spark, tmp_path):
    _tables(spark, tmp_path, [(1, 1, 1.0, 5.0, "N", "1999-05-31"), (2, 1, 1.0, 10.0, "N", "1999-07-01"),
                              (3, 1, 1.0, 4.0, "R", "1999-08-01"), (4, 2, 1.0, 3.0, "N", "1999-09-30")])
    rows = REGISTRY["accumulator_ledger"].build(spark, str(tmp_path)).collect()
    got = {r["l_orderkey"]: (r["month_value"], r["group_year"], r["total_month"], r["total_year"]) for r in rows}
    assert got == {2: (10.0, 11.0, 9.0, 14.0), 3: (6.0, 11.0, 9.0, 14.0), 4: (3.0, 3.0, 9.0, 14.0)}


def test_settlements_by_number_else_by_name(spark):
    build, root = REGISTRY["settlement_vouchers"].build, "/root/testdata/sf0.001"
    by_name = build(spark, root).collect()
    assert len(by_name) > 1 and {r["name"] for r in by_name} == {"PAGO/1997"}
    assert [r["check_number"] for r in by_name] == sorted(r["check_number"] for r in by_name)
    one = by_name[-1]
    assert build(spark, root, number=one["check_number"], name="none").collect() == [one]
    assert build(spark, root, number=None, name="none").collect() == []


def test_slip_crosstab_cells_add_up(spark):
    rows = REGISTRY["slip_crosstab"].build(spark, "/root/testdata/sf0.001").collect()
    cells = [c for c in rows[0].asDict() if c.startswith(("factura_", "recibo_"))]
    assert len(cells) == 6
    for r in rows:
        total = sum(r[c] or 0 for c in cells)
        assert (r["validation"] == "cuadrado") == (abs(total - r["deposited"]) < 0.005)
    assert {r["validation"] for r in rows} == {"cuadrado", "requiere revision"}


def test_stored_openings_kept_between_runs(spark, tmp_path):
    build, root = REGISTRY["stored_openings"].build, "/root/testdata/sf0.001"
    store = str(tmp_path / "store")
    first = sorted(build(spark, root, store=store).collect())
    assert first == sorted(build(spark, root, store=store).collect()) == sorted(build(spark, root).collect())
    assert len(list((tmp_path / "store" / "manifest").iterdir())) == 1                 # nothing changed, nothing written


SORTED = {
    "settlement_vouchers": ["check_number"],
    "journal_lines": ["o_orderkey", "l_linenumber", "l_partkey", "debit", "credit"],
    "cheque_lines": ["o_orderkey", "l_linenumber", "l_partkey", "debit", "credit"],
    "filter_lists": ["list", "label", "id"],
    "invoice_set": ["state_rank", "series", "seq", "o_orderkey"],
    "general_ledger": ["l_partkey", "l_orderkey", "l_linenumber", "amount"],
    "balance_sheet_accounts": ["l1", "l2", "l3", "p_partkey"],
}


@pytest.mark.parametrize("name", sorted(SORTED))
def test_report_order(spark, name):
    rows = REGISTRY[name].build(spark, "/root/testdata/sf0.001").select(SORTED[name]).collect()
    keys = [tuple((v is not None, v) for v in r) for r in rows]       # nulls first
    assert len(keys) > 1 and keys == sorted(keys)


def test_income_statement_order(spark):
    lines = [r["line"] for r in REGISTRY["income_statement_accounts"].build(spark, "/root/testdata/sf0.001").collect()]
    assert lines[0] == "group" and lines[-2:] == ["gross_profit", "net_profit"] and lines.count("group") == 3


def test_filter_list_cascade(spark):
    build = REGISTRY["filter_lists"].build
    months = build(spark, "/root/testdata/sf0.001", names=["mes"], parent=1997).collect()
    assert months and {r["list"] for r in months} == {"mes"} and all(r["id"].startswith("1997-") for r in months)


def test_fuel_day_without_sales(spark):
    rows = {r["pos"]: r for r in REGISTRY["fuel_day"].build(spark, "/root/testdata/sf0.001", day=dt.date(2050, 1, 1)).collect()}
    assert len(rows) == 10 and rows[1]["total"] == rows[6]["total"] == 0.0 and rows[3]["super"] is None and rows[4]["total"] == 0.0
    assert rows[7]["total"] > 0
