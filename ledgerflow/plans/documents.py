"""Document reports: master/detail, per-document nesting, three-branch unions, and the
chart series (category x day, state x month)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerflow.functions.dates import MONTH_LABELS_ES, as_date, month_name
from ledgerflow.functions.money import dec, out, ratio
from ledgerflow.functions.predicates import in_years
from ledgerflow.operators.nest import master_detail
from ledgerflow.operators.spread import join_per_key
from ledgerflow.plans.common import STATUS_LABELS, decode, sql_decode
from ledgerflow.plans.ledger import LINE_ORDER
from ledgerflow.plans.registry import report
from ledgerflow.sources import Tables


@report("master_detail_lines", "J18 J2 B16", sql=f"""
SELECT o_orderkey, o_orderstatus, l_partkey, l_quantity,
       CASE WHEN l_orderkey IS NULL THEN NULL
            ELSE row_number() OVER (PARTITION BY o_orderkey ORDER BY {", ".join(LINE_ORDER)}) END AS detail_no,
       count(l_orderkey) OVER (PARTITION BY o_orderkey) AS detail_count
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
""")
def master_detail_lines(spark, root):
    """Each document with its lines (one join instead of one sub-query per document); lines
    numbered within the document; documents without lines kept with a count of 0."""
    t = Tables(spark, root)
    m = t.orders.select("o_orderkey", "o_orderstatus")
    d = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    md = master_detail(m, d, "o_orderkey", LINE_ORDER)
    return md.select("o_orderkey", "o_orderstatus", "l_partkey", "l_quantity", "detail_no", "detail_count")


@report("document_nesting", "B16 B5 A1", sql="""
WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM lineitem)
SELECT l.l_orderkey, o_custkey, l_linenumber, CAST(amount AS DOUBLE) AS amount,
       CAST(SUM(amount) OVER (PARTITION BY l.l_orderkey) AS DOUBLE) AS doc_total,
       count(*) OVER (PARTITION BY l.l_orderkey) AS doc_lines,
       ROUND(CAST(amount AS DOUBLE) / CAST(SUM(amount) OVER (PARTITION BY l.l_orderkey) AS DOUBLE), 4) AS share
FROM l JOIN orders ON l.l_orderkey = o_orderkey
""")
def document_nesting(spark, root):
    """Rows grouped per document (cheque, voucher, invoice): each line with its document's
    total and line count (group footer values) and its share of the document."""
    t = Tables(spark, root)
    l = t.lineitem.select("l_orderkey", "l_linenumber", dec("l_extendedprice").alias("amount"))
    tot = l.groupBy("l_orderkey").agg(F.sum("amount").alias("doc_total"), F.count(F.lit(1)).alias("doc_lines"))
    j = (join_per_key(l, tot, ["l_orderkey"])
          .join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")))
    return j.select("l_orderkey", "o_custkey", "l_linenumber", F.col("amount").cast("double").alias("amount"),
                    F.col("doc_total").cast("double").alias("doc_total"), "doc_lines",
                    ratio("amount", "doc_total").alias("share"))


@report("union_branches", "O6 E27 E28 J5 E15", sql="""
WITH fee AS (
  SELECT 'cuota' AS source, o_orderkey,
         COALESCE(CASE WHEN o_orderpriority <> '5-LOW' THEN 'B-' || CAST(o_orderkey AS VARCHAR) END,
                  'REF' || CAST(o_custkey AS VARCHAR) || '/' || o_orderstatus) AS doc,
         CASE WHEN (o_orderpriority = '1-URGENT') = false THEN 'Recibo' ELSE 'Factura' END AS doc_type,
         CAST(o_totalprice AS DECIMAL(18,2)) AS amount
  FROM orders WHERE o_orderstatus = 'F'),
ret AS (
  SELECT 'devolucion' AS source, o_orderkey, 'DV-' || CAST(o_orderkey AS VARCHAR) AS doc, 'Recibo' AS doc_type,
         SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS amount
  FROM lineitem JOIN orders ON 'SO' || CAST(l_orderkey AS VARCHAR) = 'SO' || CAST(o_orderkey AS VARCHAR)
  WHERE l_returnflag = 'R' GROUP BY o_orderkey),
part AS (
  SELECT 'abono' AS source, o_orderkey, 'AB-' || CAST(o_orderkey AS VARCHAR) AS doc,
         CASE WHEN o_orderpriority IS NULL THEN 'Factura' ELSE 'Recibo' END AS doc_type,
         CAST(o_totalprice AS DECIMAL(18,2)) AS amount
  FROM orders WHERE o_orderstatus = 'P')
SELECT source, o_orderkey, doc, doc_type, CAST(amount AS DOUBLE) AS amount
FROM (SELECT * FROM fee UNION ALL SELECT * FROM ret UNION ALL SELECT * FROM part)
""")
def union_branches(spark, root):
    """Deposit-slip lines from three parallel sources stacked with UNION ALL: instalments
    (document number with a fallback to reference + state; invoice unless the flag is
    false), returns matched on a text business key, and partial payments."""
    t = Tables(spark, root)
    o = t.orders
    fee = o.where(F.col("o_orderstatus") == "F").select(
        F.lit("cuota").alias("source"), "o_orderkey",
        F.coalesce(F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("B-"), F.col("o_orderkey").cast("string"))),
                   F.concat(F.lit("REF"), F.col("o_custkey").cast("string"), F.lit("/"), "o_orderstatus")).alias("doc"),
        F.when((F.col("o_orderpriority") == "1-URGENT") == F.lit(False), "Recibo").otherwise("Factura").alias("doc_type"),
        dec("o_totalprice").alias("amount"))
    memo = F.concat(F.lit("SO"), F.col("l_orderkey").cast("string"))
    origin = F.concat(F.lit("SO"), F.col("o_orderkey").cast("string"))
    ret = (t.lineitem.where(F.col("l_returnflag") == "R").select(memo.alias("memo"), "l_extendedprice")
           .join(o.select(origin.alias("origin"), "o_orderkey"), F.col("memo") == F.col("origin"))
           .groupBy("o_orderkey").agg(F.sum(dec("l_extendedprice")).alias("amount"))
           .select(F.lit("devolucion").alias("source"), "o_orderkey",
                   F.concat(F.lit("DV-"), F.col("o_orderkey").cast("string")).alias("doc"),
                   F.lit("Recibo").alias("doc_type"), "amount"))
    part = o.where(F.col("o_orderstatus") == "P").select(
        F.lit("abono").alias("source"), "o_orderkey", F.concat(F.lit("AB-"), F.col("o_orderkey").cast("string")).alias("doc"),
        F.when(F.col("o_orderpriority").isNull(), "Factura").otherwise("Recibo").alias("doc_type"),
        dec("o_totalprice").alias("amount"))
    u = fee.unionByName(ret.select(fee.columns)).unionByName(part)
    return u.withColumn("amount", F.col("amount").cast("double"))


_MESES = "[" + ", ".join(f"'{m}'" for m in MONTH_LABELS_ES) + "]"


@report("category_series", "C1 E14 A3 R19", sql=f"""
SELECT {_MESES}[month(o_orderdate)] AS month_label, month(o_orderdate) AS mon, day(o_orderdate) AS dom,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
FROM orders GROUP BY 1, 2, 3
""")
def category_series(spark, root):
    """Chart series: month name (series) x day of month (category) -> amount."""
    o = Tables(spark, root).orders
    return (o.groupBy(month_name("o_orderdate", MONTH_LABELS_ES).alias("month_label"),
                      F.month("o_orderdate").alias("mon"), F.dayofmonth("o_orderdate").alias("dom"))
             .agg(F.sum(dec("o_totalprice")).cast("double").alias("amount")))


@report("time_series", "C2 E1 P8 A3 R20", sql=f"""
SELECT {sql_decode('o_orderstatus', STATUS_LABELS)} AS state, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
       CAST(ROUND(SUM(CAST(o_totalprice AS DECIMAL(18,2))), 2) AS DOUBLE) AS amount
FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999
GROUP BY 1, 2
""")
def time_series(spark, root, first_year=1996, last_year=1999):
    """Chart series: state label (series) x month (time) -> amount, for a span of years."""
    o = Tables(spark, root).orders.where(in_years("o_orderdate", range(first_year, last_year + 1)))
    return (o.groupBy(decode(F.col("o_orderstatus"), STATUS_LABELS).alias("state"),
                      F.trunc(as_date("o_orderdate"), "MM").alias("month"))
             .agg(out(F.sum(dec("o_totalprice"))).alias("amount")))
