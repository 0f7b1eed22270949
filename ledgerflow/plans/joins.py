"""Join-centred reports: role-playing dimensions, semi/anti joins, correlated scalars,
fan-out, business keys and the key x calendar spine."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerflow.functions.dates import as_date
from ledgerflow.functions.money import dec, out, ratio
from ledgerflow.operators.balances import month_spine
from ledgerflow.operators.nest import exclusive_rows
from ledgerflow.operators.pivot import wide_pivot
from ledgerflow.operators.totals import cross_scalar
from ledgerflow.plans.common import SQL_LINE_AMOUNT, line_amount
from ledgerflow.plans.registry import report
from ledgerflow.sources import Tables


@report("role_playing_join", "J1 J6 A1", sql=f"""
SELECT cr.r_name AS cust_region, sr.r_name AS supp_region,
       CAST(ROUND(SUM({SQL_LINE_AMOUNT}), 2) AS DOUBLE) AS revenue, count(*) AS n_lines
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey
JOIN supplier ON l_suppkey = s_suppkey
JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey
GROUP BY cr.r_name, sr.r_name
""")
def role_playing_join(spark, root):
    """Revenue by customer region x supplier region: nation and region joined in two roles."""
    t = Tables(spark, root)
    geo = (t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
                   .select("n_nationkey", "r_name"))                      # 25 rows: broadcast
    cust = (t.customer.join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
                      .select("c_custkey", F.col("r_name").alias("cust_region")))
    supp = (t.supplier.join(geo, F.col("s_nationkey") == F.col("n_nationkey"))
                      .select("s_suppkey", F.col("r_name").alias("supp_region")))
    li = t.lineitem.select("l_orderkey", "l_suppkey", line_amount().alias("amt"))
    j = (li.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
           .join(cust, F.col("o_custkey") == F.col("c_custkey"))
           .join(supp, F.col("l_suppkey") == F.col("s_suppkey")))
    return j.groupBy("cust_region", "supp_region").agg(
        out(F.sum("amt")).alias("revenue"), F.count(F.lit(1)).alias("n_lines"))


@report("semi_anti_keys", "J10 J11 A6", sql="""
WITH with_ret AS (
  SELECT o_orderstatus, count(*) AS orders_with_returns FROM orders
  WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
  GROUP BY o_orderstatus),
excl AS (
  SELECT o_orderstatus, count(*) AS exclusive_lines
  FROM lineitem l JOIN orders ON l.l_orderkey = o_orderkey
  WHERE NOT EXISTS (SELECT 1 FROM lineitem l2
                    WHERE l2.l_orderkey = l.l_orderkey AND l2.l_partkey = l.l_partkey
                      AND l2.l_suppkey <> l.l_suppkey)
  GROUP BY o_orderstatus)
SELECT COALESCE(with_ret.o_orderstatus, excl.o_orderstatus) AS o_orderstatus,
       COALESCE(orders_with_returns, 0) AS orders_with_returns, COALESCE(exclusive_lines, 0) AS exclusive_lines
FROM with_ret FULL OUTER JOIN excl ON with_ret.o_orderstatus = excl.o_orderstatus
""")
def semi_anti_keys(spark, root):
    """Documents having a returned line (semi join) and lines whose product does not appear
    in the same document from another supplier (the NOT EXISTS on two keys plus a residual,
    computed as a per-group aggregate so a large group is never expanded into pairs)."""
    t = Tables(spark, root)
    o = t.orders.select("o_orderkey", "o_orderstatus")
    returned = t.lineitem.where(F.col("l_returnflag") == "R").select("l_orderkey")
    semi = (o.join(returned, o.o_orderkey == returned.l_orderkey, "left_semi")
             .groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders_with_returns")))
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey")
    excl = exclusive_rows(lines, ["l_orderkey", "l_partkey"], "l_suppkey")
    anti = (excl.join(o, F.col("l_orderkey") == o.o_orderkey)
                .groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("exclusive_lines")))
    j = semi.join(anti, "o_orderstatus", "full")
    return j.select("o_orderstatus", F.coalesce("orders_with_returns", F.lit(0)).alias("orders_with_returns"),
                    F.coalesce("exclusive_lines", F.lit(0)).alias("exclusive_lines"))


FREIGHT_TYPE = "PROMO"


@report("freight_flag", "J12 J13 J2 E1 R37", sql=f"""
SELECT o_orderkey,
       CASE WHEN (SELECT count(*) FROM lineitem JOIN part ON l_partkey = p_partkey
                  WHERE l_orderkey = o_orderkey AND p_type = '{FREIGHT_TYPE}') > 0 THEN 'CF' ELSE 'SF' END AS freight_flag,
       COALESCE((SELECT SUM(l_quantity) FROM lineitem JOIN part ON l_partkey = p_partkey
                 WHERE l_orderkey = o_orderkey AND p_type = '{FREIGHT_TYPE}'), 0) AS freight_qty,
       CAST(ROUND(CAST(o_totalprice AS DECIMAL(18,2)), 2) AS DOUBLE) AS total
FROM orders
""")
def freight_flag(spark, root, freight_type=FREIGHT_TYPE):
    """Freight flag from a correlated count and freight quantity from a correlated sum,
    decorrelated into one pre-aggregation and a left join."""
    t = Tables(spark, root)
    freight_parts = t.part.where(F.col("p_type") == freight_type).select("p_partkey")
    fl = (t.lineitem.join(freight_parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
                    .groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q")))
    j = t.orders.join(fl, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select("o_orderkey",
                    F.when(F.coalesce("n", F.lit(0)) > 0, "CF").otherwise("SF").alias("freight_flag"),
                    F.coalesce("q", F.lit(0.0)).alias("freight_qty"), out(dec("o_totalprice")).alias("total"))


# Currency of a line by its flag (the per-currency totals of the logistics report).
CURRENCY_OF_FLAG = [("A", "usd"), ("N", "gtq"), ("R", "eur")]


@report("per_class_scalar_sums", "J14 J2 A11", sql=f"""
WITH s AS (
  SELECT l_orderkey,
         {", ".join(f"SUM({SQL_LINE_AMOUNT}) FILTER (WHERE l_returnflag = '{f}') AS s_{c}" for f, c in CURRENCY_OF_FLAG)}
  FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, {", ".join(f"CAST(ROUND(COALESCE(s_{c}, 0), 2) AS DOUBLE) AS total_{c}" for _, c in CURRENCY_OF_FLAG)}
FROM orders LEFT JOIN s ON o_orderkey = l_orderkey
""")
def per_class_scalar_sums(spark, root):
    """One correlated sum per currency, as FILTER sums per document and one left join."""
    t = Tables(spark, root)
    s = wide_pivot(t.lineitem, ["l_orderkey"], "l_returnflag",
                   [(f, f"s_{c}") for f, c in CURRENCY_OF_FLAG], line_amount(), fill=None)
    j = t.orders.select("o_orderkey").join(s, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select("o_orderkey", *[out(F.coalesce(f"s_{c}", F.lit(0))).alias(f"total_{c}")
                                    for _, c in CURRENCY_OF_FLAG])


@report("scalar_cross_total", "J8 A4 A5 J15", sql=f"""
WITH g AS (SELECT l_returnflag, l_linestatus, SUM({SQL_LINE_AMOUNT}) AS revenue, SUM(l_quantity) AS qty
           FROM lineitem GROUP BY 1, 2),
t AS (SELECT SUM({SQL_LINE_AMOUNT}) AS total_revenue, CAST(MIN(l_shipdate) AS DATE) AS first_ship,
             CAST(MAX(l_shipdate) AS DATE) AS last_ship FROM lineitem)
SELECT l_returnflag, l_linestatus, CAST(ROUND(revenue, 2) AS DOUBLE) AS revenue, qty,
       ROUND(CAST(revenue AS DOUBLE) / CAST(total_revenue AS DOUBLE), 4) AS share,
       CAST(ROUND(total_revenue, 2) AS DOUBLE) AS total_revenue, first_ship, last_ship
FROM g, t
""")
def scalar_cross_total(spark, root):
    """Group sums cross-joined with one-row scalar aggregates (total, first and last date)."""
    li = Tables(spark, root).lineitem.select("l_returnflag", "l_linestatus", "l_quantity", "l_shipdate",
                                             line_amount().alias("amt"))
    g = li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("amt").alias("revenue"), F.sum("l_quantity").alias("qty"))
    t = li.agg(F.sum("amt").alias("total_revenue"), as_date(F.min("l_shipdate")).alias("first_ship"),
               as_date(F.max("l_shipdate")).alias("last_ship"))
    j = cross_scalar(g, t)
    return j.select("l_returnflag", "l_linestatus", out("revenue").alias("revenue"), "qty",
                    ratio("revenue", "total_revenue").alias("share"), out("total_revenue").alias("total_revenue"),
                    "first_ship", "last_ship")


@report("fanout_pairs", "J20 Q9 R29", sql="""
WITH a AS (SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'N'),
b AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag <> 'N'),
pairs AS (SELECT a.l_orderkey, count(*) AS n_pairs, SUM(a.l_quantity) AS repeated_qty
          FROM a JOIN b ON a.l_orderkey = b.l_orderkey GROUP BY a.l_orderkey),
dedup AS (SELECT a.l_orderkey, SUM(a.l_quantity) AS matched_qty
          FROM a JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey GROUP BY a.l_orderkey)
SELECT pairs.l_orderkey, n_pairs, repeated_qty, COALESCE(matched_qty, 0) AS matched_qty
FROM pairs LEFT JOIN dedup ON pairs.l_orderkey = dedup.l_orderkey
""")
def fanout_pairs(spark, root):
    """Totals of the fan-out join "invoice lines x order lines by document only" (quantities
    repeat once per partner line) and of the de-duplicated join on document and product.

    The pairs are never built: per document the fan-out sums equal (sum over one side) x
    (row count of the other side), so both sides are aggregated first and then joined on
    their keys — no group is expanded into all of its pairs.
    """
    li = Tables(spark, root).lineitem
    a = li.where(F.col("l_returnflag") == "N")
    b = li.where(F.col("l_returnflag") != "N")
    a_doc = a.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("na"), F.sum("l_quantity").alias("qa"))
    b_doc = b.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("nb"))
    doc = a_doc.join(b_doc, "l_orderkey").select(
        "l_orderkey", (F.col("na") * F.col("nb")).alias("n_pairs"), (F.col("qa") * F.col("nb")).alias("repeated_qty"))
    a_pp = a.groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("qa"))
    b_pp = b.groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("nb"))
    matched = (a_pp.join(b_pp, ["l_orderkey", "l_partkey"])
                   .groupBy("l_orderkey").agg(F.sum(F.col("qa") * F.col("nb")).alias("matched_qty")))
    j = doc.join(matched, "l_orderkey", "left")
    return j.select("l_orderkey", "n_pairs", "repeated_qty",
                    F.coalesce("matched_qty", F.lit(0.0)).alias("matched_qty"))


@report("business_key_join", "J5 P3 P14 A1", sql="""
WITH hdr AS (SELECT 'SO' || CAST(o_orderkey AS VARCHAR) AS origin, o_orderkey FROM orders WHERE o_orderstatus = 'F'),
ln AS (SELECT 'SO' || CAST(l_orderkey AS VARCHAR) AS memo, l_quantity FROM lineitem WHERE l_linestatus <> 'O')
SELECT o_orderkey, count(*) AS n_lines, SUM(l_quantity) AS qty
FROM hdr JOIN ln ON hdr.origin = ln.memo GROUP BY o_orderkey
""")
def business_key_join(spark, root, state="F", skip_line_status="O"):
    """Headers and lines matched on a text business key (origin = memo)."""
    t = Tables(spark, root)
    hdr = t.orders.where(F.col("o_orderstatus") == state).select(
        F.concat(F.lit("SO"), F.col("o_orderkey").cast("string")).alias("origin"), "o_orderkey")
    ln = t.lineitem.where(F.col("l_linestatus") != skip_line_status).select(
        F.concat(F.lit("SO"), F.col("l_orderkey").cast("string")).alias("memo"), "l_quantity")
    return (hdr.join(ln, hdr.origin == ln.memo).groupBy("o_orderkey")
               .agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty")))


@report("account_calendar_gaps", "J9 J4 J2 S3 E4", sql=f"""
WITH span AS (SELECT date_trunc('month', MIN(l_shipdate)) AS lo, date_trunc('month', MAX(l_shipdate)) AS hi FROM lineitem),
spine AS (
  SELECT p_type, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month
  FROM (SELECT DISTINCT p_type FROM part), span),
mv AS (
  SELECT p_type, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
         SUM({SQL_LINE_AMOUNT}) AS amount, count(*) AS n_lines
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT spine.p_type, spine.month, CAST(ROUND(COALESCE(amount, 0), 2) AS DOUBLE) AS amount,
       COALESCE(n_lines, 0) AS n_lines
FROM spine LEFT JOIN mv ON spine.p_type = mv.p_type AND spine.month = mv.month
""")
def account_calendar_gaps(spark, root, start=None, end=None):
    """Every account group x month from the first to the last movement (or ``start`` to
    ``end``), with movements or 0 (key x calendar spine, left join on the composite key)."""
    t = Tables(spark, root)
    spine = month_spine(t.part.select("p_type").distinct(), t.lineitem.select(as_date("l_shipdate").alias("d")), start, end)
    mv = (t.lineitem.join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
                    .groupBy("p_type", F.trunc(as_date("l_shipdate"), "MM").alias("month"))
                    .agg(F.sum(line_amount()).alias("amount"), F.count(F.lit(1)).alias("n_lines")))
    j = spine.join(mv, ["p_type", "month"], "left")
    return j.select("p_type", "month", out(F.coalesce("amount", F.lit(0))).alias("amount"),
                    F.coalesce("n_lines", F.lit(0)).alias("n_lines"))
