"""Books and document listings (report jobs R01, R02, R06-R08, R11, R12, R21, R36, R43, R45)."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ledgerflow.functions.dates import as_date
from ledgerflow.functions.money import dec, gross_up, out
from ledgerflow.functions.predicates import date_between, in_list, in_periods, in_years
from ledgerflow.operators.nest import master_detail
from ledgerflow.operators.spread import join_per_key
from ledgerflow.operators.totals import cross_scalar, with_total_row
from ledgerflow.plans.common import SQL_LINE_AMOUNT, decode, line_amount, sql_decode
from ledgerflow.plans.ledger import LINE_ORDER
from ledgerflow.plans.registry import report
from ledgerflow.session import ensure_checkpoint_dir
from ledgerflow.sources import PublishedReport, Tables

PERIODS = (199801, 199802, 199803)
TAX_RATE = "0.12"


@report("purchase_tax_ledger", "R01 P2 J1 E5 E6 O1", sql=f"""
SELECT s_name, l_orderkey AS doc, year(l_shipdate) * 100 + month(l_shipdate) AS period,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS net,
       CAST(ROUND(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) * {TAX_RATE}, 3) AS DOUBLE) AS vat,
       CAST(ROUND(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) * {TAX_RATE} + SUM(CAST(l_extendedprice AS DECIMAL(18,2))), 3) AS DOUBLE) AS total
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
WHERE year(l_shipdate) * 100 + month(l_shipdate) IN {PERIODS}
GROUP BY s_name, l_orderkey, year(l_shipdate) * 100 + month(l_shipdate)
""")
def purchase_tax_ledger(spark, root, periods=PERIODS):
    """Purchase book for chosen periods: per supplier document, net, VAT and gross-up total."""
    t = Tables(spark, root)
    period = F.year("l_shipdate") * 100 + F.month("l_shipdate")
    li = t.lineitem.where(in_periods("l_shipdate", periods))
    j = li.join(t.supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    g = j.groupBy("s_name", F.col("l_orderkey").alias("doc"), period.alias("period")).agg(
        F.sum(dec("l_extendedprice")).alias("net"))
    return g.select("s_name", "doc", "period", F.col("net").cast("double").alias("net"),
                    F.round(F.col("net") * F.lit(TAX_RATE).cast("decimal(6,4)"), 3).cast("double").alias("vat"),
                    gross_up(F.col("net"), TAX_RATE, 3).cast("double").alias("total"))


@report("sales_tax_ledger", "R02 P2 J1 E5 E6 O1", sql=f"""
SELECT o_orderkey, c_name, year(o_orderdate) * 100 + month(o_orderdate) AS period,
       CAST(ROUND(SUM({SQL_LINE_AMOUNT}), 2) AS DOUBLE) AS net,
       CAST(ROUND(ROUND(SUM({SQL_LINE_AMOUNT}), 2) * {TAX_RATE}, 3) AS DOUBLE) AS vat,
       CAST(ROUND(ROUND(SUM({SQL_LINE_AMOUNT}), 2) * {TAX_RATE} + ROUND(SUM({SQL_LINE_AMOUNT}), 2), 3) AS DOUBLE) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE year(o_orderdate) * 100 + month(o_orderdate) IN {PERIODS}
GROUP BY o_orderkey, c_name, year(o_orderdate) * 100 + month(o_orderdate)
""")
def sales_tax_ledger(spark, root, periods=PERIODS):
    """Sales book for chosen periods: per invoice, net (after discount), VAT and total."""
    t = Tables(spark, root)
    period = F.year("o_orderdate") * 100 + F.month("o_orderdate")
    o = t.orders.where(in_periods("o_orderdate", periods)).select("o_orderkey", "o_custkey", period.alias("period"))
    j = (o.join(t.customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
          .join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")))
    g = j.groupBy("o_orderkey", "c_name", "period").agg(F.round(F.sum(line_amount()), 2).alias("net"))
    return g.select("o_orderkey", "c_name", "period", F.col("net").cast("double").alias("net"),
                    F.round(F.col("net") * F.lit(TAX_RATE).cast("decimal(6,4)"), 3).cast("double").alias("vat"),
                    gross_up(F.col("net"), TAX_RATE, 3).cast("double").alias("total"))


JV_FROM, JV_TO = dt.date(1995, 1, 1), dt.date(2001, 12, 31)
JV_STATES = ("F", "O")


@report("journal_vouchers", "R06 J18 J1 P1 P2 P12 E12 B3", sql=f"""
WITH m AS (SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS fecha FROM orders
           WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '{JV_FROM}' AND DATE '{JV_TO}' AND o_orderstatus IN {JV_STATES}),
d AS (SELECT m.*, l_partkey, l_orderkey,
             CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS debit,
             CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS credit,
             CASE WHEN l_orderkey IS NULL THEN NULL
                  ELSE row_number() OVER (PARTITION BY o_orderkey ORDER BY {", ".join(LINE_ORDER)}) END AS detail_no
      FROM m LEFT JOIN lineitem ON o_orderkey = l_orderkey)
SELECT o_orderkey, fecha, detail_no, l_partkey, CAST(debit AS DOUBLE) AS debit, CAST(credit AS DOUBLE) AS credit,
       CAST(COALESCE(SUM(debit) OVER (PARTITION BY o_orderkey), 0) AS DOUBLE) AS voucher_debit,
       CAST(COALESCE(SUM(credit) OVER (PARTITION BY o_orderkey), 0) AS DOUBLE) AS voucher_credit
FROM d
""")
def journal_vouchers(spark, root, start=JV_FROM, end=JV_TO, states=JV_STATES):
    """Journal vouchers of a period with their lines (one join, not a sub-report per voucher),
    debit/credit per line and the voucher totals."""
    t = Tables(spark, root)
    m = t.orders.where(date_between("o_orderdate", start, end) & in_list("o_orderstatus", states)).select(
        "o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("fecha"))
    amt = dec("l_extendedprice")
    d = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), *LINE_ORDER,
                          F.when(F.col("l_returnflag") != "R", amt).alias("debit"),
                          F.when(F.col("l_returnflag") == "R", amt).alias("credit"))
    md = master_detail(m, d, "o_orderkey", LINE_ORDER)
    tot = d.join(m.select("o_orderkey"), "o_orderkey", "left_semi").groupBy("o_orderkey").agg(
        F.sum("debit").alias("voucher_debit"), F.sum("credit").alias("voucher_credit"))
    j = md.join(tot, "o_orderkey", "left")
    return j.select("o_orderkey", "fecha", "detail_no", "l_partkey", F.col("debit").cast("double").alias("debit"),
                    F.col("credit").cast("double").alias("credit"),
                    F.coalesce("voucher_debit", F.lit(0)).cast("double").alias("voucher_debit"),
                    F.coalesce("voucher_credit", F.lit(0)).cast("double").alias("voucher_credit"))


MJ_YEARS = (1996, 1997)


@report("monthly_journal", "R07 J3 P2 A1 E33 E34 B1 B2", sql=f"""
WITH g AS (
  SELECT year(l_shipdate) AS yr, month(l_shipdate) AS mon, p_type,
         NULLIF(SUM(CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END), 0) AS debit,
         NULLIF(SUM(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END), 0) AS credit
  FROM lineitem, part WHERE l_partkey = p_partkey AND year(l_shipdate) IN {MJ_YEARS}
  GROUP BY 1, 2, 3)
SELECT yr, mon, p_type, CAST(debit AS DOUBLE) AS debit, CAST(credit AS DOUBLE) AS credit,
       CASE WHEN debit IS NULL THEN '' ELSE p_type END AS debit_name,
       CASE WHEN credit IS NULL THEN '' ELSE p_type END AS credit_name,
       CAST(SUM(debit) OVER (PARTITION BY yr, mon) AS DOUBLE) AS month_debit,
       CAST(SUM(credit) OVER (PARTITION BY yr, mon) AS DOUBLE) AS month_credit
FROM g
""")
def monthly_journal(spark, root, years=MJ_YEARS):
    """Monthly journal: debit and credit per account group and month (0 shown as NULL, its
    label blank) with the month's totals on each row."""
    t = Tables(spark, root)
    li = t.lineitem.where(in_years("l_shipdate", years))
    j = li.join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    amt = dec("l_extendedprice")
    is_credit = F.col("l_returnflag") == "R"
    g = j.groupBy(F.year("l_shipdate").alias("yr"), F.month("l_shipdate").alias("mon"), "p_type").agg(
        F.nullif(F.sum(F.when(~is_credit, amt).otherwise(F.lit(0))), F.lit(0)).alias("debit"),
        F.nullif(F.sum(F.when(is_credit, amt).otherwise(F.lit(0))), F.lit(0)).alias("credit"))
    month = g.groupBy("yr", "mon").agg(F.sum("debit").alias("month_debit"), F.sum("credit").alias("month_credit"))
    r = g.join(month, ["yr", "mon"])
    return r.select("yr", "mon", "p_type", F.col("debit").cast("double").alias("debit"),
                    F.col("credit").cast("double").alias("credit"),
                    F.when(F.col("debit").isNull(), "").otherwise(F.col("p_type")).alias("debit_name"),
                    F.when(F.col("credit").isNull(), "").otherwise(F.col("p_type")).alias("credit_name"),
                    F.col("month_debit").cast("double").alias("month_debit"),
                    F.col("month_credit").cast("double").alias("month_credit"))


@report("account_sides_totals", "R08 A1 A4 A5 J8 P14 E12 E37 Q10", sql="""
WITH e AS (
  SELECT l_suppkey, l_orderkey,
         SUM(CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS debit,
         SUM(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS credit,
         min(l_shipdate) AS first_d, max(l_shipdate) AS last_d
  FROM lineitem GROUP BY l_suppkey, l_orderkey),
a AS (SELECT l_suppkey, count(*) FILTER (WHERE debit <> 0) AS n_debit, SUM(debit) AS total_debit,
             count(*) FILTER (WHERE credit <> 0) AS n_credit, SUM(credit) AS total_credit,
             min(first_d) AS first_d, max(last_d) AS last_d FROM e GROUP BY l_suppkey),
t AS (SELECT SUM(total_debit) AS all_debit, SUM(total_credit) AS all_credit FROM a)
SELECT l_suppkey, n_debit, CAST(total_debit AS DOUBLE) AS total_debit, n_credit, CAST(total_credit AS DOUBLE) AS total_credit,
       strftime(first_d, '%d/%m/%Y') AS first_date, strftime(last_d, '%d/%m/%Y') AS last_date,
       CAST(all_debit AS DOUBLE) AS all_debit, CAST(all_credit AS DOUBLE) AS all_credit, 'Libro mayor' AS title
FROM a, t
""")
def account_sides_totals(spark, root):
    """Ledger by account (supplier): entries with a non-zero debit and credit side, side
    totals (sums of amounts, not of running balances), first and last date, and the
    report totals from a one-row aggregate."""
    li = Tables(spark, root).lineitem
    amt = dec("l_extendedprice")
    e = li.groupBy("l_suppkey", "l_orderkey").agg(
        F.sum(F.when(F.col("l_returnflag") != "R", amt).otherwise(F.lit(0))).alias("debit"),
        F.sum(F.when(F.col("l_returnflag") == "R", amt).otherwise(F.lit(0))).alias("credit"),
        F.min("l_shipdate").alias("first_d"), F.max("l_shipdate").alias("last_d"))
    a = e.groupBy("l_suppkey").agg(
        F.count(F.when(F.col("debit") != 0, 1)).alias("n_debit"), F.sum("debit").alias("total_debit"),
        F.count(F.when(F.col("credit") != 0, 1)).alias("n_credit"), F.sum("credit").alias("total_credit"),
        F.min("first_d").alias("first_d"), F.max("last_d").alias("last_d"))
    tot = a.agg(F.sum("total_debit").alias("all_debit"), F.sum("total_credit").alias("all_credit"))
    j = cross_scalar(a, tot)
    return j.select("l_suppkey", "n_debit", F.col("total_debit").cast("double").alias("total_debit"), "n_credit",
                    F.col("total_credit").cast("double").alias("total_credit"),
                    F.date_format("first_d", "dd/MM/yyyy").alias("first_date"),
                    F.date_format("last_d", "dd/MM/yyyy").alias("last_date"),
                    F.col("all_debit").cast("double").alias("all_debit"),
                    F.col("all_credit").cast("double").alias("all_credit"), F.lit("Libro mayor").alias("title"))


RJ_CLOSED = dt.date(1998, 3, 16)


@report("republished_journal", "S8 R07 A2 E10", sql="""
SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS period, p_type,
       CAST(SUM(CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS debit,
       CAST(SUM(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS credit,
       count(*) AS n_lines
FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate IS NOT NULL GROUP BY 1, 2
""")
def republished_journal(spark, root, store=None, closed=RJ_CLOSED):
    """Journal by period and account group as published: first with the lines before ``closed``,
    then again for the periods from that day's on, which replaces the period that it cuts and adds
    the later ones; the earlier periods are not written again. ``store`` is the folder of the
    report, by default a fresh one in ``spark.checkpoint.dir``."""
    t = Tables(spark, root)
    amt, is_credit, zero = dec("l_extendedprice"), F.col("l_returnflag") == "R", F.lit(0)

    def journal(lines):
        j = lines.join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        return j.groupBy((F.year("l_shipdate") * 100 + F.month("l_shipdate")).alias("period"), "p_type").agg(
            F.sum(F.when(~is_credit, amt).otherwise(zero)).cast("double").alias("debit"),
            F.sum(F.when(is_credit, amt).otherwise(zero)).cast("double").alias("credit"), F.count(F.lit(1)).alias("n_lines"))

    report = PublishedReport(spark, store or f"{ensure_checkpoint_dir(spark)}/journal-{uuid.uuid4().hex}", "period")
    report.publish(journal(t.lineitem.where(F.col("l_shipdate") < F.lit(closed))))
    report.publish(journal(t.lineitem.where(F.col("l_shipdate") >= F.lit(closed.replace(day=1)))))
    return report.read()



EJ_FROM, EJ_TO = dt.date(1995, 1, 1), dt.date(2001, 12, 31)
EJ_STATES = ("F", "O", "P")


@report("entry_journal", "R21 J1 P1 P6 O2 B2 B3 Q8", sql=f"""
WITH g AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS entry_no, count(*) AS n_lines,
         SUM(CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS debit,
         SUM(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS credit
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '{EJ_FROM}' AND DATE '{EJ_TO}' AND o_orderstatus IN {EJ_STATES}
    AND o_orderpriority IS NOT NULL
  GROUP BY o_orderkey)
SELECT entry_no, n_lines, CAST(debit AS DOUBLE) AS debit, CAST(credit AS DOUBLE) AS credit FROM g
UNION ALL SELECT 'Total', SUM(n_lines), CAST(SUM(debit) AS DOUBLE), CAST(SUM(credit) AS DOUBLE) FROM g
""")
def entry_journal(spark, root, start=EJ_FROM, end=EJ_TO, states=EJ_STATES):
    """Journal by entry: lines of the entries of a period in the given states (posted and,
    when asked, unposted), subtotals per entry and the report total; entries sort by their
    number compared as a number."""
    t = Tables(spark, root)
    o = t.orders.where(date_between("o_orderdate", start, end) & in_list("o_orderstatus", states)
                       & F.col("o_orderpriority").isNotNull()).select("o_orderkey")
    j = o.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    amt = dec("l_extendedprice")
    g = j.groupBy(F.col("o_orderkey").cast("string").alias("entry_no")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.when(F.col("l_returnflag") != "R", amt).otherwise(F.lit(0))).alias("debit"),
        F.sum(F.when(F.col("l_returnflag") == "R", amt).otherwise(F.lit(0))).alias("credit"))
    tot = g.agg(F.sum("n_lines").alias("n_lines"), F.sum("debit").alias("debit"), F.sum("credit").alias("credit"))
    r = with_total_row(g, "entry_no", "Total", tot)
    r = r.orderBy(F.col("entry_no").try_cast("decimal(38,0)").asc_nulls_last())
    return r.select("entry_no", F.col("n_lines").cast("long").alias("n_lines"),
                    F.col("debit").cast("double").alias("debit"), F.col("credit").cast("double").alias("credit"))


@report("journal_lines", "R21 J1 P1 P6 O2 B1 B2 B3", sql=f"""
WITH l AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, l_linenumber, l_partkey,
         CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END AS d,
         CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END AS c
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '{EJ_FROM}' AND DATE '{EJ_TO}' AND o_orderstatus IN {EJ_STATES}
    AND o_orderpriority IS NOT NULL)
SELECT o_orderkey, day, l_linenumber, l_partkey, CAST(d AS DOUBLE) AS debit, CAST(c AS DOUBLE) AS credit,
       CAST(SUM(d) OVER (PARTITION BY o_orderkey) AS DOUBLE) AS entry_debit,
       CAST(SUM(c) OVER (PARTITION BY o_orderkey) AS DOUBLE) AS entry_credit
FROM l
""")
def journal_lines(spark, root, start=EJ_FROM, end=EJ_TO, states=EJ_STATES):
    """The entries of ``entry_journal`` with their lines, by entry number and line, each line
    with its entry's subtotals (aggregated by entry, joined back so that a hot entry is split)."""
    t = Tables(spark, root)
    o = t.orders.where(date_between("o_orderdate", start, end) & in_list("o_orderstatus", states)
                       & F.col("o_orderpriority").isNotNull()).select("o_orderkey", as_date("o_orderdate").alias("day"))
    amt, zero, is_credit = dec("l_extendedprice"), F.lit(0), F.col("l_returnflag") == "R"
    l = (o.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
          .select("o_orderkey", "day", "l_linenumber", "l_partkey", F.when(~is_credit, amt).otherwise(zero).alias("debit"),
                  F.when(is_credit, amt).otherwise(zero).alias("credit")))
    sums = l.groupBy("o_orderkey").agg(F.sum("debit").alias("entry_debit"), F.sum("credit").alias("entry_credit"))
    r = join_per_key(l, sums, ["o_orderkey"]).select("o_orderkey", "day", "l_linenumber", "l_partkey", *[
        F.col(c).cast("double").alias(c) for c in ("debit", "credit", "entry_debit", "entry_credit")])
    return r.orderBy("o_orderkey", "l_linenumber", "l_partkey", "debit", "credit")


PH_FROM, PH_TO = dt.date(1995, 1, 1), dt.date(2001, 12, 31)
PH_COMPANY = "AUTOMOBILE"
PH_KINDS = ("1-URGENT", "2-HIGH", "3-MEDIUM")


@report("payment_history", "R36 J1 J5 P1 P2 P10 P12", sql=f"""
WITH p AS (SELECT o_orderkey, 'PAY' || CAST(o_orderkey AS VARCHAR) AS ref, CAST(o_totalprice AS DECIMAL(18,2)) AS amount
           FROM orders JOIN customer ON o_custkey = c_custkey
           WHERE c_mktsegment = '{PH_COMPANY}' AND o_orderstatus = 'F'
             AND CAST(o_orderdate AS DATE) BETWEEN DATE '{PH_FROM}' AND DATE '{PH_TO}' AND o_orderpriority IN {PH_KINDS}),
a AS (SELECT 'PAY' || CAST(l_orderkey AS VARCHAR) AS memo, SUM(ROUND({SQL_LINE_AMOUNT}, 2)) AS applied FROM lineitem GROUP BY 1)
SELECT o_orderkey, CAST(amount AS DOUBLE) AS amount, CAST(COALESCE(applied, 0) AS DOUBLE) AS applied,
       CAST(amount - COALESCE(applied, 0) AS DOUBLE) AS not_applied
FROM p LEFT JOIN a ON p.ref = a.memo
""")
def payment_history(spark, root, start=PH_FROM, end=PH_TO, company=PH_COMPANY, kinds=PH_KINDS):
    """Payments of one company in a period and of chosen kinds, with the amount applied to
    invoice lines (matched on a text reference) and the part not applied."""
    t = Tables(spark, root)
    c = t.customer.where(F.col("c_mktsegment") == company).select("c_custkey")
    p = (t.orders.where((F.col("o_orderstatus") == "F") & date_between("o_orderdate", start, end)
                        & in_list("o_orderpriority", kinds))
               .join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
               .select("o_orderkey", F.concat(F.lit("PAY"), F.col("o_orderkey").cast("string")).alias("ref"),
                       dec("o_totalprice").alias("amount")))
    memo = F.concat(F.lit("PAY"), F.col("l_orderkey").cast("string")).alias("memo")
    a = (t.lineitem.select(memo, F.round(line_amount(), 2).alias("line"))
                   .join(p.select("ref"), F.col("memo") == F.col("ref"), "left_semi")
                   .groupBy("memo").agg(F.sum("line").alias("applied")))
    j = p.join(a, F.col("ref") == F.col("memo"), "left").withColumn("applied", F.coalesce("applied", F.lit(0)))
    return j.select("o_orderkey", F.col("amount").cast("double").alias("amount"),
                    F.col("applied").cast("double").alias("applied"),
                    (F.col("amount") - F.col("applied")).cast("double").alias("not_applied"))


INS_RATE = "0.056"
TI_FROM, TI_TO = dt.date(1995, 1, 1), dt.date(2001, 12, 31)
FREIGHT_TYPES = ("PROMO",)


@report("transport_insurance", "R43 A24 P1 P5 J1 A1", sql=f"""
SELECT l_orderkey, l_suppkey AS vehicle, SUM(l_quantity) AS qty,
       CAST(ROUND(SUM(CAST(l_quantity AS DECIMAL(18,2))) * {INS_RATE}, 2) AS DOUBLE) AS fee
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '{TI_FROM}' AND DATE '{TI_TO}' AND p_type NOT IN {FREIGHT_TYPES + ('',)}
GROUP BY l_orderkey, l_suppkey
""")
def transport_insurance(spark, root, start=TI_FROM, end=TI_TO, excluded=FREIGHT_TYPES):
    """Insurance fee per invoice and vehicle: sum of quantity x rate, freight excluded."""
    t = Tables(spark, root)
    li = t.lineitem.where(date_between("l_shipdate", start, end))
    p = t.part.where(~F.col("p_type").isin([*excluded, ""])).select("p_partkey")
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return j.groupBy("l_orderkey", F.col("l_suppkey").alias("vehicle")).agg(
        F.sum("l_quantity").alias("qty"),
        out(F.sum(dec("l_quantity")) * F.lit(INS_RATE).cast("decimal(6,4)")).alias("fee"))


IS_NATIONS = (0, 5, 10, 15, 20)
INSURED_FROM = 5000
IS_FROM, IS_TO = dt.date(1995, 1, 1), dt.date(2001, 12, 31)


@report("insured_sales", "R45 J1 J6 P1 P2 A1", sql=f"""
SELECT cn.n_name AS customer_nation, sn.n_name AS seller_nation, c_custkey,
       CAST(ROUND(SUM({SQL_LINE_AMOUNT}), 2) AS DOUBLE) AS sales
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation sn ON s_nationkey = sn.n_nationkey
WHERE c_acctbal > {INSURED_FROM} AND c_nationkey IN {IS_NATIONS}
  AND CAST(o_orderdate AS DATE) BETWEEN DATE '{IS_FROM}' AND DATE '{IS_TO}'
GROUP BY 1, 2, 3
""")
def insured_sales(spark, root, nations=IS_NATIONS, start=IS_FROM, end=IS_TO):
    """Sales of credit-insured customers of chosen countries by customer and seller country."""
    t = Tables(spark, root)
    nat = t.nation.select("n_nationkey", "n_name")
    c = (t.customer.where((F.col("c_acctbal") > INSURED_FROM) & in_list("c_nationkey", nations))
                   .join(nat, F.col("c_nationkey") == F.col("n_nationkey"))
                   .select("c_custkey", F.col("n_name").alias("customer_nation")))
    s = (t.supplier.join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
                   .select("s_suppkey", F.col("n_name").alias("seller_nation")))
    o = t.orders.where(date_between("o_orderdate", start, end)).select("o_orderkey", "o_custkey")
    own = o.join(c, F.col("o_custkey") == F.col("c_custkey"))       # the chosen customers' documents before the lines
    j = (t.lineitem.join(own, F.col("l_orderkey") == F.col("o_orderkey"))
                   .join(s, F.col("l_suppkey") == F.col("s_suppkey")))
    return j.groupBy("customer_nation", "seller_nation", "c_custkey").agg(out(F.sum(line_amount())).alias("sales"))


PR_FROM, PR_TO = dt.date(1995, 1, 1), dt.date(2001, 12, 31)
# Labels of the line states on the repayment list.
LINE_STATUS_LABELS = {"F": "Aplicado", "O": "Pendiente"}


@report("principal_repayments", "R11 J1 P1 P3 E1 E12 A4 O9", sql=f"""
WITH r AS (
  SELECT l_orderkey, {sql_decode('l_linestatus', LINE_STATUS_LABELS)} AS label,
         strftime(l_shipdate, '%d/%m/%Y') AS fecha, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_returnflag = 'A' AND o_orderstatus = 'F'
    AND CAST(l_shipdate AS DATE) BETWEEN DATE '{PR_FROM}' AND DATE '{PR_TO}')
SELECT CAST(l_orderkey AS VARCHAR) AS loan, label, fecha, l_linenumber, CAST(amount AS DOUBLE) AS amount FROM r
UNION ALL SELECT 'Total', NULL, NULL, NULL, CAST(SUM(amount) AS DOUBLE) FROM r
""")
def principal_repayments(spark, root, start=PR_FROM, end=PR_TO):
    """Principal repayments of a period on paid loans with state labels, and a total row."""
    t = Tables(spark, root)
    li = t.lineitem.where((F.col("l_returnflag") == "A") & date_between("l_shipdate", start, end))
    o = t.orders.where(F.col("o_orderstatus") == "F").select("o_orderkey")
    r = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(
        F.col("l_orderkey").cast("string").alias("loan"), decode(F.col("l_linestatus"), LINE_STATUS_LABELS).alias("label"),
        F.date_format("l_shipdate", "dd/MM/yyyy").alias("fecha"), "l_linenumber", dec("l_extendedprice").alias("amount"))
    tot = r.agg(F.sum("amount").alias("amount"))
    return with_total_row(r, "loan", "Total", tot).withColumn("amount", F.col("amount").cast("double"))


EN_NATIONS = (2, 4, 6, 8)


@report("enrolment_list", "R12 J1 P2 P12 E12 E15 A5", sql=f"""
SELECT c_custkey, c_name || ' (' || c_mktsegment || ')' AS student,
       strftime(min(o_orderdate), '%d/%m/%Y') AS enrolled, count(*) AS n_open
FROM customer JOIN orders ON o_custkey = c_custkey
WHERE c_nationkey IN {EN_NATIONS} AND o_orderstatus = 'O'
GROUP BY c_custkey, c_name, c_mktsegment
""")
def enrolment_list(spark, root, nations=EN_NATIONS):
    """Enrolment list: partners of chosen countries with open documents, labelled and dated."""
    t = Tables(spark, root)
    c = t.customer.where(in_list("c_nationkey", nations))
    j = c.join(t.orders.where(F.col("o_orderstatus") == "O"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_custkey", "c_name", "c_mktsegment").agg(
        F.min("o_orderdate").alias("first"), F.count(F.lit(1)).alias("n_open")).select(
        "c_custkey", F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")")).alias("student"),
        F.date_format("first", "dd/MM/yyyy").alias("enrolled"), "n_open")
