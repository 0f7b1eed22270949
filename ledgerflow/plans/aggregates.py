"""Aggregate reports: group sums with HAVING, global statistics, conditional totals,
tagged net income, rollup statements and the distinct-subtotal rule."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerflow.functions.dates import as_date, year_start
from ledgerflow.functions.money import dec, out
from ledgerflow.operators.pivot import crosstab_totals
from ledgerflow.operators.totals import with_total_row
from ledgerflow.plans.common import SQL_SIGNED, signed_amount
from ledgerflow.plans.registry import report
from ledgerflow.sources import Tables

INSURANCE_RATE = "0.056"


@report("group_sums", "A1 A2 A3 A24 P11 J3 S1 R43", sql=f"""
SELECT * FROM (
  SELECT year(l_shipdate) AS yr, p_type, SUM(l_quantity) AS qty,
         CAST(ROUND(SUM({SQL_SIGNED}), 2) AS DOUBLE) AS balance,
         CAST(ROUND(SUM(CAST(l_quantity AS DECIMAL(18,2))) * {INSURANCE_RATE}, 2) AS DOUBLE) AS insurance_fee
  FROM lineitem, part WHERE l_partkey = p_partkey
  GROUP BY year(l_shipdate), p_type) g
WHERE balance > 0
""")
def group_sums(spark, root):
    """Per year and account group: quantity, balance = debit - credit, insurance fee = qty x rate;
    groups with a positive balance only (filter on the aggregate)."""
    t = Tables(spark, root)
    j = t.lineitem.join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    g = j.groupBy(F.year("l_shipdate").alias("yr"), "p_type").agg(
        F.sum("l_quantity").alias("qty"),
        out(F.sum(signed_amount())).alias("balance"),
        out(F.sum(dec("l_quantity")) * F.lit(INSURANCE_RATE).cast("decimal(6,4)")).alias("insurance_fee"))
    return g.where(F.col("balance") > 0)


@report("global_stats", "A4 A5 A6 O1 O4", sql="""
SELECT count(*) AS n_docs, count(o_orderpriority) AS n_with_kind,
       CAST(min(o_orderdate) AS DATE) AS first_date, CAST(max(o_orderdate) AS DATE) AS last_date,
       CAST(ROUND(SUM(CAST(o_totalprice AS DECIMAL(18,2))), 2) AS DOUBLE) AS total,
       CAST(ROUND(min(CAST(o_totalprice AS DECIMAL(18,2))), 2) AS DOUBLE) AS smallest,
       CAST(ROUND(max(CAST(o_totalprice AS DECIMAL(18,2))), 2) AS DOUBLE) AS largest
FROM orders
""")
def global_stats(spark, root):
    """Report-wide aggregates without keys (count, min, max, sum)."""
    o = Tables(spark, root).orders
    return o.agg(F.count(F.lit(1)).alias("n_docs"), F.count("o_orderpriority").alias("n_with_kind"),
                 as_date(F.min("o_orderdate")).alias("first_date"), as_date(F.max("o_orderdate")).alias("last_date"),
                 out(F.sum(dec("o_totalprice"))).alias("total"), out(F.min(dec("o_totalprice"))).alias("smallest"),
                 out(F.max(dec("o_totalprice"))).alias("largest"))


@report("conditional_totals", "B3 B6 B7 O9", sql="""
WITH g AS (
  SELECT o_orderpriority AS kind, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS total,
         SUM(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS paid,
         SUM(abs(CAST(c_acctbal AS DECIMAL(18,2)))) AS abs_balances, count(*) AS n_docs
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_orderpriority)
SELECT kind, CAST(total AS DOUBLE) AS total, CAST(paid AS DOUBLE) AS paid,
       CAST(abs_balances AS DOUBLE) AS abs_balances, n_docs FROM g
UNION ALL
SELECT 'Total', CAST(SUM(total) AS DOUBLE), CAST(SUM(paid) AS DOUBLE), CAST(SUM(abs_balances) AS DOUBLE), SUM(n_docs) FROM g
""")
def conditional_totals(spark, root):
    """Group and report totals: plain sum, conditional sum (paid only), sum of absolute values."""
    t = Tables(spark, root)
    j = t.orders.join(t.customer.select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"))
    amt = dec("o_totalprice")
    g = j.groupBy(F.col("o_orderpriority").alias("kind")).agg(
        F.sum(amt).alias("total"), F.sum(F.when(F.col("o_orderstatus") == "F", amt).otherwise(F.lit(0))).alias("paid"),
        F.sum(F.abs(dec("c_acctbal"))).alias("abs_balances"), F.count(F.lit(1)).alias("n_docs"))
    tot = g.agg(F.sum("total").alias("total"), F.sum("paid").alias("paid"),
                F.sum("abs_balances").alias("abs_balances"), F.sum("n_docs").alias("n_docs"))
    res = with_total_row(g, "kind", "Total", tot)
    return res.select("kind", *[F.col(c).cast("double").alias(c) for c in ("total", "paid", "abs_balances")],
                      F.col("n_docs").cast("long").alias("n_docs"))


# The four tagged account sets of the net income formula, as (group, tag).
TAG_SETS = {
    "gross": ("ECONOMY", "Brand#12"),
    "operating": ("SMALL", "Brand#23"),
    "fin_income": ("ECONOMY", "Brand#22"),
    "fin_cost": ("SMALL", "Brand#7"),
}
NET_END = dt.date(2000, 6, 30)


def _tagged_sql() -> str:
    sums = ",\n  ".join(
        f"abs(SUM({SQL_SIGNED}) FILTER (WHERE p_type = '{g}' AND p_brand = '{b}')) AS {n}"
        for n, (g, b) in TAG_SETS.items())
    return f"""
WITH s AS (SELECT
  {sums}
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  WHERE o_orderstatus = 'F' AND CAST(l_shipdate AS DATE) BETWEEN DATE '{NET_END.year}-01-01' AND DATE '{NET_END}'
    AND p_size > 0 AND p_retailprice > 0 AND p_partkey >= 0 AND length(p_brand) > 0
    AND p_name NOT LIKE 'red%')
SELECT {", ".join(f"CAST(COALESCE({n}, 0) AS DOUBLE) AS {n}" for n in TAG_SETS)},
       CAST((COALESCE(gross, 0) - COALESCE(operating, 0)) + COALESCE(fin_income, 0) - COALESCE(fin_cost, 0) AS DOUBLE) AS net_income
FROM s"""


@report("tagged_net_total", "A23 P9 P7 J10 B14", sql=_tagged_sql())
def tagged_net_total(spark, root, end=NET_END):
    """Net income = (gross - operating) + financial income - financial cost, each the absolute
    balance of a tagged account set over posted lines from 1 January to ``end`` — one pass
    with four filtered sums instead of four scans."""
    t = Tables(spark, root)
    acc = t.part.where((F.col("p_size") > 0) & (F.col("p_retailprice") > 0) & (F.col("p_partkey") >= 0)
                       & (F.length("p_brand") > 0) & ~F.col("p_name").startswith("red"))
    posted = t.orders.where(F.col("o_orderstatus") == "F").select("o_orderkey")
    li = t.lineitem.where(as_date("l_shipdate").between(year_start(F.lit(end)), F.lit(end)))
    j = (li.join(acc, F.col("l_partkey") == F.col("p_partkey"))
           .join(posted, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi"))
    s = j.agg(*[F.abs(F.sum(F.when((F.col("p_type") == g) & (F.col("p_brand") == b), signed_amount()))).alias(n)
                for n, (g, b) in TAG_SETS.items()])
    z = {n: F.coalesce(F.col(n), F.lit(0)) for n in TAG_SETS}
    return s.select(*[z[n].cast("double").alias(n) for n in TAG_SETS],
                    ((z["gross"] - z["operating"]) + z["fin_income"] - z["fin_cost"]).cast("double").alias("net_income"))


ST_FROM, ST_TO = dt.date(1999, 1, 1), dt.date(1999, 12, 31)


@report("rollup_statement", "B17 B13 B14 A2 W8", sql=f"""
WITH leaf AS (
  SELECT p_type, p_brand,
         SUM(CASE WHEN CAST(l_shipdate AS DATE) < DATE '{ST_FROM}' THEN {SQL_SIGNED} ELSE 0 END) AS opening,
         SUM(CASE WHEN CAST(l_shipdate AS DATE) BETWEEN DATE '{ST_FROM}' AND DATE '{ST_TO}' AND l_returnflag <> 'R'
                  THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS debit,
         SUM(CASE WHEN CAST(l_shipdate AS DATE) BETWEEN DATE '{ST_FROM}' AND DATE '{ST_TO}' AND l_returnflag = 'R'
                  THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS credit
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE CAST(l_shipdate AS DATE) <= DATE '{ST_TO}'
  GROUP BY p_type, p_brand),
r AS (
  SELECT p_type, p_brand, GROUPING(p_type, p_brand) AS gid,
         SUM(opening) AS opening, SUM(debit) AS debit, SUM(credit) AS credit
  FROM leaf GROUP BY ROLLUP (p_type, p_brand)),
lines AS (
  SELECT CAST(NULL AS VARCHAR) AS line, p_type, p_brand, gid, opening, debit, credit FROM r
  UNION ALL
  SELECT 'gross_profit', NULL, NULL, NULL,
         SUM(CASE WHEN p_type = 'ECONOMY' THEN opening ELSE 0 END) - SUM(CASE WHEN p_type = 'STANDARD' THEN opening ELSE 0 END),
         SUM(CASE WHEN p_type = 'ECONOMY' THEN debit ELSE 0 END) - SUM(CASE WHEN p_type = 'STANDARD' THEN debit ELSE 0 END),
         SUM(CASE WHEN p_type = 'ECONOMY' THEN credit ELSE 0 END) - SUM(CASE WHEN p_type = 'STANDARD' THEN credit ELSE 0 END)
  FROM r WHERE gid = 1)
SELECT line, p_type, p_brand, gid, CAST(opening AS DOUBLE) AS opening, CAST(debit AS DOUBLE) AS debit,
       CAST(credit AS DOUBLE) AS credit, CAST(opening + debit - credit AS DOUBLE) AS closing
FROM lines
""")
def rollup_statement(spark, root, start=ST_FROM, end=ST_TO):
    """Trial-balance style statement: opening, debit, credit, closing per (group, subgroup),
    rolled up to group and grand totals in one aggregation, plus a derived line computed
    from the group totals (no second pass over the lines)."""
    t = Tables(spark, root)
    d = as_date("l_shipdate")
    amt = dec("l_extendedprice")
    in_period = d.between(F.lit(start), F.lit(end))
    j = (t.lineitem.where(d <= F.lit(end))
                   .join(t.part.select("p_partkey", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey")))
    leaf = j.groupBy("p_type", "p_brand").agg(
        F.sum(F.when(d < F.lit(start), signed_amount()).otherwise(F.lit(0))).alias("opening"),
        F.sum(F.when(in_period & (F.col("l_returnflag") != "R"), amt).otherwise(F.lit(0))).alias("debit"),
        F.sum(F.when(in_period & (F.col("l_returnflag") == "R"), amt).otherwise(F.lit(0))).alias("credit"))
    r = crosstab_totals(leaf, ["p_type", "p_brand"], [],
                        [F.sum(c).alias(c) for c in ("opening", "debit", "credit")])
    groups = r.where(F.col("gid") == 1)

    def diff(c):
        return (F.sum(F.when(F.col("p_type") == "ECONOMY", F.col(c)).otherwise(F.lit(0)))
                - F.sum(F.when(F.col("p_type") == "STANDARD", F.col(c)).otherwise(F.lit(0)))).alias(c)
    derived = groups.agg(diff("opening"), diff("debit"), diff("credit")).select(
        F.lit("gross_profit").alias("line"), F.lit(None).cast("string").alias("p_type"),
        F.lit(None).cast("string").alias("p_brand"), F.lit(None).cast("int").alias("gid"), "opening", "debit", "credit")
    rows = r.select(F.lit(None).cast("string").alias("line"), "p_type", "p_brand", F.col("gid").cast("int").alias("gid"),
                    "opening", "debit", "credit")
    res = rows.unionByName(derived)
    return res.select("line", "p_type", "p_brand", "gid", *[F.col(c).cast("double").alias(c) for c in ("opening", "debit", "credit")],
                      (F.col("opening") + F.col("debit") - F.col("credit")).cast("double").alias("closing"))


DS_FROM, DS_TO = dt.date(1998, 1, 1), dt.date(1998, 12, 31)


@report("distinct_subtotals", "A8 E37 Q5", sql=f"""
WITH sub AS (
  SELECT l_partkey, SUM({SQL_SIGNED}) AS subtotal FROM lineitem
  WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '{DS_FROM}' AND DATE '{DS_TO}'
  GROUP BY l_partkey)
SELECT CAST(SUM(DISTINCT abs(subtotal)) AS DOUBLE) AS total_distinct_abs,
       CAST(SUM(abs(subtotal)) AS DOUBLE) AS total_abs, count(*) AS n_accounts, 'GTQ' AS currency
FROM sub
""")
def distinct_subtotals(spark, root, start=DS_FROM, end=DS_TO):
    """Grand total of absolute account subtotals, by the reference rule (DISTINCT values, so
    equal subtotals of two accounts count once) and by the per-account rule."""
    li = Tables(spark, root).lineitem.where(as_date("l_shipdate").between(F.lit(start), F.lit(end)))
    sub = li.groupBy("l_partkey").agg(F.sum(signed_amount()).alias("subtotal"))
    return sub.agg(F.sum_distinct(F.abs("subtotal")).cast("double").alias("total_distinct_abs"),
                   F.sum(F.abs("subtotal")).cast("double").alias("total_abs"),
                   F.count(F.lit(1)).alias("n_accounts"), F.lit("GTQ").alias("currency"))
