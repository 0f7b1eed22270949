"""Plan checks: no Python UDFs, no window over one global partition, filters pushed to the scan."""

import re

import pytest

import __spark_entry__ as E
from ledgerflow.plans import REGISTRY

SF_DIR = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_plan_shape(spark, name):
    p = _plan(E.queries()[name](spark, SF_DIR))
    assert "PythonUDF" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert not _rows_in_one_task(p), f"{name}: rows gathered in one task"


def _operator(line: str) -> str:
    return re.sub(r"^[\s:|+*()\d-]*", "", line).split(" ")[0].split("(")[0]


def _rows_in_one_task(plan: str) -> list[str]:
    """Single-partition exchanges whose input is not an aggregate, a limit or one row of literals.

    An aggregate below them is either a total's partial sums or the summary of an ordered scan,
    which holds at most two rows a chunk."""
    lines, bad = plan.splitlines(), []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = (_operator(x) for x in lines[i + 1:])
            child = next(x for x in below if x not in ("Project", "Filter", "AdaptiveSparkPlan", ""))
            if "Aggregate" not in child and "Limit" not in child:
                bad.append(child)
    return bad


def test_global_windows_over_rows_are_found(spark):
    rows = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    bad = rows.selectExpr("row_number() OVER (ORDER BY o_orderdate) AS n")
    assert _rows_in_one_task(_plan(bad))
    assert not _rows_in_one_task(_plan(rows.groupBy().count()))


ONE_SCAN = ["pivots_joined", "invoice_set", "payment_vouchers", "cheque_register", "payment_history", "insured_sales",
            "net_units_crosstab", "fuel_day"]


@pytest.mark.parametrize("name", ONE_SCAN)
def test_lines_are_scanned_once(spark, name):
    p = _plan(E.queries()[name](spark, SF_DIR))
    assert sum("FileScan parquet" in x and "l_orderkey" in x for x in p.splitlines()) == 1


@pytest.mark.parametrize("name", ["insured_sales", "payment_vouchers", "role_playing_join", "optional_key_predicate"])
def test_no_broadcast_without_a_size_check(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in _plan(E.queries()[name](spark, SF_DIR))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filters_reach_the_scan(spark):
    q = E.queries()["date_range_in_list"](spark, SF_DIR)
    p = q._jdf.queryExecution().executedPlan().toString()
    scan = [l for l in p.splitlines() if "FileScan parquet" in l and "o_orderkey" in l][0]
    assert "PushedFilters: [" in scan and "o_orderdate" in scan and "o_orderstatus" in scan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double," in scan


def test_period_lists_push_a_date_range(spark):
    q = E.queries()["purchase_tax_ledger"](spark, SF_DIR)
    p = q._jdf.queryExecution().executedPlan().toString()
    scan = [l for l in p.splitlines() if "FileScan parquet" in l and "l_shipdate" in l][0]
    assert "GreaterThanOrEqual(l_shipdate" in scan and "LessThan(l_shipdate" in scan
