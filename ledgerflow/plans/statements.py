"""Statement-style reports: shares with a total row, conditional and global totals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerflow.functions.money import dec, out
from ledgerflow.operators.totals import cross_scalar, share_text, with_total_row
from ledgerflow.plans.common import PRIORITY_LABELS, decode, sql_decode
from ledgerflow.plans.registry import report
from ledgerflow.sources import Tables

SHARE_FROM = dt.date(1996, 1, 1)
SHARE_TO = dt.date(2000, 12, 31)


@report("status_share_total", "R24 A10 E1 E23 O9 J15 P1 P5", sql=f"""
WITH base AS (
  SELECT {sql_decode('o_orderpriority', PRIORITY_LABELS)} AS kind, o_orderpriority,
         CAST(o_totalprice AS DECIMAL(18,2)) AS amt
  FROM orders
  WHERE o_orderstatus IN ('O', 'F')
    AND CAST(o_orderdate AS DATE) BETWEEN DATE '{SHARE_FROM}' AND DATE '{SHARE_TO}'),
g AS (SELECT CASE WHEN o_orderpriority IS NULL THEN 'Otros' ELSE kind END AS state_label,
             SUM(amt) AS total_state FROM base GROUP BY 1),
t AS (SELECT SUM(total_state) AS total FROM g)
SELECT state_label, CAST(ROUND(total_state, 2) AS DOUBLE) AS total_state,
       CAST(CAST(ROUND(100.0 * CAST(total_state AS DOUBLE) / CAST(total AS DOUBLE)) AS BIGINT) AS VARCHAR) || '%' AS share
FROM g, t
UNION ALL
SELECT 'Total', CAST(ROUND(total, 2) AS DOUBLE), '100%' FROM t
""")
def status_share_total(spark, root, date_from=SHARE_FROM, date_to=SHARE_TO, states=("O", "F")):
    """Invoiced amount per journal kind in a date range, its share of the total, and a total row."""
    o = Tables(spark, root).orders
    base = (o.where(F.col("o_orderstatus").isin(list(states))
                    & F.to_date("o_orderdate").between(F.lit(date_from), F.lit(date_to)))
             .select(F.when(F.col("o_orderpriority").isNull(), F.lit("Otros"))
                      .otherwise(decode(F.col("o_orderpriority"), PRIORITY_LABELS)).alias("state_label"),
                     dec("o_totalprice").alias("amt")))
    g = base.groupBy("state_label").agg(F.sum("amt").alias("total_state"))
    total = g.agg(F.sum("total_state").alias("total"))          # one row, from the small aggregate
    rows = cross_scalar(g, total).select(
        "state_label", out("total_state").alias("total_state"),
        share_text(F.col("total_state"), F.col("total")).alias("share"))
    total_row = total.select(out("total").alias("total_state"), F.lit("100%").alias("share"))
    return with_total_row(rows, "state_label", "Total", total_row)
