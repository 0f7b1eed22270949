"""Projection-centred reports: decodes, tax gross-up, dates, document numbers, text, words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerflow.functions.dates import (MONTH_LABELS_ES, as_date, days_between, long_date_es, month_name,
                                        prev_month_end, year_start)
from ledgerflow.functions.money import dec, gross_up, out, ratio
from ledgerflow.functions.text import key_after, split_docnum
from ledgerflow.functions.words import CURRENCIES, HUNDREDS, MAX_AMOUNT, TENS, UNITS, amount_in_words
from ledgerflow.plans.common import STATUS_LABELS, decode, sql_decode
from ledgerflow.plans.registry import report
from ledgerflow.sources import Tables, values

_SQL_STATUS = sql_decode("o_orderstatus", STATUS_LABELS)


@report("decode_nested_status", "E1 E2 J2 A6", sql=f"""
WITH l AS (
  SELECT l_orderkey, count(*) AS n_lines,
         count(*) FILTER (WHERE l_linestatus = 'O') AS n_open,
         count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned
  FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, {_SQL_STATUS} AS status_label,
       CASE WHEN o_orderstatus = 'F' THEN
              CASE WHEN n_returned > 0 THEN 'Pagada con devolucion' ELSE 'Pagada' END
            WHEN o_orderstatus = 'O' THEN
              CASE WHEN n_lines IS NULL THEN 'Sin lineas'
                   WHEN n_open = n_lines THEN 'Abierta' ELSE 'Abierta parcial' END
            ELSE CASE WHEN n_lines IS NULL THEN 'Sin lineas' ELSE 'Parcial' END END AS nested_status,
       COALESCE(n_lines, 0) AS n_lines
FROM orders LEFT JOIN l ON o_orderkey = l_orderkey
""")
def decode_nested_status(spark, root):
    """Header state label plus a state derived from the header and its lines."""
    t = Tables(spark, root)
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count(F.when(F.col("l_linestatus") == "O", 1)).alias("n_open"),
        F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("n_returned"))
    j = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    st, n, n_open, n_ret = F.col("o_orderstatus"), F.col("n_lines"), F.col("n_open"), F.col("n_returned")
    nested = (F.when(st == "F", F.when(n_ret > 0, "Pagada con devolucion").otherwise("Pagada"))
               .when(st == "O", F.when(n.isNull(), "Sin lineas").when(n_open == n, "Abierta")
                     .otherwise("Abierta parcial"))
               .otherwise(F.when(n.isNull(), "Sin lineas").otherwise("Parcial")))
    return j.select("o_orderkey", decode(st, STATUS_LABELS).alias("status_label"),
                    nested.alias("nested_status"), F.coalesce(n, F.lit(0)).alias("n_lines"))


@report("tax_gross_up", "E5 E6 A1", sql="""
SELECT l_orderkey,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS net,
       CAST(SUM(ROUND(CAST(l_extendedprice AS DECIMAL(18,2)) * 0.12 + CAST(l_extendedprice AS DECIMAL(18,2)), 3)) AS DOUBLE) AS gross,
       CAST(ROUND(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) * 0.12, 2) AS DOUBLE) AS tax2,
       CAST(ROUND(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2))), 5) AS DOUBLE) AS tax5
FROM lineitem GROUP BY l_orderkey
""")
def tax_gross_up(spark, root):
    """Per document: net amount, gross-up at 12% rounded per line to 3, tax rounded to 2 and 5."""
    li = Tables(spark, root).lineitem
    x = dec("l_extendedprice")
    return li.groupBy("l_orderkey").agg(
        F.sum(x).cast("double").alias("net"),
        F.sum(gross_up("l_extendedprice", "0.12", 3)).cast("double").alias("gross"),
        F.round(F.sum(x) * F.lit("0.12").cast("decimal(6,4)"), 2).cast("double").alias("tax2"),
        F.round(F.sum(x * dec("l_tax")), 5).cast("double").alias("tax5"))


@report("elapsed_days", "E8 E9 E10 E11 J1 A5", sql="""
SELECT o_orderkey,
       max(datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS max_ship_days,
       min(datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS min_ship_days,
       CAST(date_trunc('month', CAST(o_orderdate AS DATE)) - INTERVAL 1 DAY AS DATE) AS prev_month_end,
       CAST(date_trunc('year', CAST(o_orderdate AS DATE)) AS DATE) AS year_start,
       year(o_orderdate) AS yr, month(o_orderdate) AS mon
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY o_orderkey, o_orderdate
""")
def elapsed_days(spark, root):
    """Day differences between documents and their lines, period bounds and date parts."""
    t = Tables(spark, root)
    j = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    d = days_between("l_shipdate", "o_orderdate")
    return (j.groupBy("o_orderkey", "o_orderdate")
             .agg(F.max(d).alias("max_ship_days"), F.min(d).alias("min_ship_days"))
             .select("o_orderkey", F.col("max_ship_days").cast("long").alias("max_ship_days"),
                     F.col("min_ship_days").cast("long").alias("min_ship_days"),
                     prev_month_end("o_orderdate").alias("prev_month_end"),
                     year_start("o_orderdate").alias("year_start"),
                     F.year("o_orderdate").cast("long").alias("yr"), F.month("o_orderdate").cast("long").alias("mon")))


def _sql_list(words):
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


_MES = _sql_list(["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto",
                  "septiembre", "octubre", "noviembre", "diciembre"])


@report("spanish_long_date", "E12 E13 E14 A7", sql=f"""
SELECT day,
       lpad(CAST(day(day) AS VARCHAR), 2, '0') || ' de ' || {_MES}[month(day)] || ' del ' || CAST(year(day) AS VARCHAR) AS long_date,
       {_sql_list(MONTH_LABELS_ES)}[month(day)] AS month_label,
       strftime(day, '%d/%m/%Y') AS short_date
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
""")
def spanish_long_date(spark, root):
    """Every document date as ``DD de <mes> del YYYY``, month label and ``dd/MM/yyyy``."""
    days = Tables(spark, root).orders.select(as_date("o_orderdate").alias("day")).distinct()
    return days.select("day", long_date_es("day").alias("long_date"),
                       month_name("day", MONTH_LABELS_ES).alias("month_label"),
                       F.date_format("day", "dd/MM/yyyy").alias("short_date"))


_DOCNUM_SQL = """CASE o_orderkey % 4
      WHEN 0 THEN o_orderstatus || '-' || CAST(o_orderkey AS VARCHAR)
      WHEN 1 THEN o_orderstatus || '/' || CAST(year(o_orderdate) AS VARCHAR) || '/' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0')
      WHEN 2 THEN o_orderstatus || '-' || o_orderpriority
      ELSE o_orderstatus || CAST(o_orderkey AS VARCHAR) END"""


# the place of the mark between series and sequence in ``docnum``
SQL_MARK = """CASE WHEN instr(docnum, '-') > 0 THEN instr(docnum, '-')
                     WHEN instr(docnum, '/') > 0 AND instr(substr(docnum, instr(docnum, '/') + 1), '/') > 0
                     THEN instr(docnum, '/') + instr(substr(docnum, instr(docnum, '/') + 1), '/') END"""


def docnum():
    """Document numbers in four forms, made from the order's own columns."""
    k = F.col("o_orderkey")
    return (F.when(k % 4 == 0, F.concat("o_orderstatus", F.lit("-"), k.cast("string")))
             .when(k % 4 == 1, F.concat("o_orderstatus", F.lit("/"), F.year("o_orderdate").cast("string"),
                                        F.lit("/"), F.lpad(k.cast("string"), 7, "0")))
             .when(k % 4 == 2, F.concat("o_orderstatus", F.lit("-"), "o_orderpriority"))
             .otherwise(F.concat("o_orderstatus", k.cast("string"))))


@report("docnum_split", "E16 E25 E7 J1 R35", sql=f"""
WITH d AS (SELECT o_orderkey, o_custkey, {_DOCNUM_SQL} AS docnum FROM orders),
p AS (SELECT *, {SQL_MARK} AS pos FROM d)
SELECT o_orderkey, docnum,
       CASE WHEN pos IS NOT NULL THEN substr(docnum, 1, pos - 1) END AS series,
       TRY_CAST(CASE WHEN pos IS NOT NULL THEN substr(docnum, pos + 1) END AS BIGINT) AS seq,
       TRY_CAST(substr(c_name, 10) AS BIGINT) AS cust_no
FROM p JOIN customer ON o_custkey = c_custkey
""")
def docnum_split(spark, root):
    """Document numbers split into series and sequence; partner number taken out of its name."""
    t = Tables(spark, root)
    d = t.orders.select("o_orderkey", "o_custkey", docnum().alias("docnum"))
    series, seq = split_docnum("docnum")
    j = d.join(t.customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return j.select("o_orderkey", "docnum", series.alias("series"), seq.alias("seq"),
                    key_after("c_name", 10).alias("cust_no"))


@report("text_labels", "E15 E17 E18 E4 E7 E35 E37", sql="""
SELECT c_custkey,
       trim(c_name) || ' - ' || upper(c_mktsegment) AS label,
       lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS padded,
       translate(c_name, '#', '') AS no_hash,
       position('#' IN c_name) AS hash_pos,
       overlay(c_name PLACING 'CLI' FROM 1 FOR 8) AS short_name,
       ltrim('  ' || c_mktsegment) AS segment,
       CAST(CAST(COALESCE(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END, 0) AS DECIMAL(18,2)) AS DOUBLE) AS bal_or_zero,
       CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS bal_text,
       'GTQ' AS currency, CAST(NULL AS VARCHAR) AS note
FROM customer
""")
def text_labels(spark, root):
    """Partner labels: concat, trim, upper, pad, character removal, position, overlay, defaults."""
    c = Tables(spark, root).customer
    return c.select(
        "c_custkey",
        F.concat(F.trim("c_name"), F.lit(" - "), F.upper("c_mktsegment")).alias("label"),
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("padded"),
        F.translate("c_name", "#", "").alias("no_hash"),
        F.instr("c_name", "#").cast("long").alias("hash_pos"),
        F.overlay("c_name", F.lit("CLI"), F.lit(1), F.lit(8)).alias("short_name"),
        F.ltrim(F.concat(F.lit("  "), "c_mktsegment")).alias("segment"),
        F.coalesce(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), F.lit(0)).cast("decimal(18,2)").cast("double").alias("bal_or_zero"),
        dec("c_acctbal").cast("string").alias("bal_text"),
        F.lit("GTQ").alias("currency"), F.lit(None).cast("string").alias("note"))


INTEREST_RATE, LATE_RATE = 18.0, 5.0


@report("fee_arithmetic", "E19 E24 E29 E30 J13 R30", sql=f"""
WITH o AS (SELECT o_custkey, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS requested, count(*) AS n_docs
           FROM orders GROUP BY o_custkey)
SELECT c_custkey,
       CASE WHEN c_acctbal < 0 THEN 0.0
            ELSE ROUND(c_acctbal / (CAST(requested AS DOUBLE) / 12.0 / 1000.0), 4) END AS factor,
       CAST(ROUND(abs(CAST(c_acctbal AS DECIMAL(18,2))), 2) AS DOUBLE) AS abs_balance,
       ROUND(CAST(requested AS DOUBLE) * {INTEREST_RATE} / 100 * {LATE_RATE} / 100, 2) AS late_fee,
       CAST(COALESCE(n_docs, 0) + c_nationkey AS BIGINT) AS row_sum,
       ROUND(CAST(requested AS DOUBLE) / NULLIF(n_docs, 0) * COALESCE(n_docs, 0), 2) AS volume_x_avg
FROM customer LEFT JOIN o ON o_custkey = c_custkey
""")
def fee_arithmetic(spark, root, interest=INTEREST_RATE, late=LATE_RATE):
    """Loan-style arithmetic per partner: guarded factor, absolute balance, late fee, row sums."""
    t = Tables(spark, root)
    o = t.orders.groupBy("o_custkey").agg(F.sum(dec("o_totalprice")).alias("requested"),
                                          F.count(F.lit(1)).alias("n_docs"))
    j = t.customer.join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    req = F.col("requested").cast("double")
    instalment = req / F.lit(12.0) / F.lit(1000.0)
    factor = F.when(F.col("c_acctbal") < 0, F.lit(0.0)).otherwise(ratio(F.col("c_acctbal"), instalment))
    return j.select(
        "c_custkey", factor.alias("factor"),
        out(F.abs(dec("c_acctbal"))).alias("abs_balance"),
        F.round(req * F.lit(interest) / 100 * F.lit(late) / 100, 2).alias("late_fee"),
        (F.coalesce(F.col("n_docs"), F.lit(0)) + F.col("c_nationkey")).cast("long").alias("row_sum"),
        F.round(F.try_divide(req, F.col("n_docs").cast("double")) * F.coalesce(F.col("n_docs"), F.lit(0)), 2)
         .alias("volume_x_avg"))


# A hierarchy path code per (part type, size class), as an inline relation.
PATH_CODES = [
    ("ECONOMY", "S", "1.1"), ("ECONOMY", "L", "1.2"),
    ("LARGE", "S", "2.1"), ("LARGE", "L", "2.2"),
    ("MEDIUM", "S", "3.1"), ("MEDIUM", "L", "3.2"),
    ("PROMO", "S", "4.1"), ("PROMO", "L", "4.2"),
    ("SMALL", "S", "5.1"),
]
SMALL_SIZES = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25)


@report("two_value_bucket", "E32 E3 S2 O7 J2 J4", sql=f"""
WITH codes(ptype, sclass, path) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in PATH_CODES)}),
p AS (SELECT p_partkey, p_type,
             CASE WHEN p_size IN {SMALL_SIZES} THEN 'S' ELSE 'L' END AS size_class FROM part)
SELECT p_partkey, size_class, path
FROM p LEFT JOIN codes ON p.p_type = codes.ptype AND p.size_class = codes.sclass
""")
def two_value_bucket(spark, root):
    """Two-value bucket by an id list, then a path code from a two-column decode relation."""
    p = Tables(spark, root).part.select(
        "p_partkey", "p_type",
        F.when(F.col("p_size").isin(list(SMALL_SIZES)), "S").otherwise("L").alias("size_class"))
    codes = values(spark, PATH_CODES, "ptype string, sclass string, path string")   # literal, broadcast
    j = p.join(codes, (p.p_type == codes.ptype) & (p.size_class == codes.sclass), "left")
    return j.select("p_partkey", "size_class", "path")


@report("zero_to_null", "E33 E34 A1", sql="""
WITH s AS (
  SELECT l_orderkey,
         NULLIF(SUM(CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2)) ELSE 0 END), 0) AS debit,
         NULLIF(SUM(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2)) ELSE 0 END), 0) AS credit
  FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CAST(debit AS DOUBLE) AS debit, CAST(credit AS DOUBLE) AS credit,
       CASE WHEN debit IS NULL THEN '' ELSE 'Debe ' || CAST(l_orderkey AS VARCHAR) END AS debit_name,
       CASE WHEN credit IS NULL THEN '' ELSE 'Haber ' || CAST(l_orderkey AS VARCHAR) END AS credit_name
FROM s
""")
def zero_to_null(spark, root):
    """Debit and credit discount sums per document, 0 shown as NULL and its label blank."""
    li = Tables(spark, root).lineitem
    amt = dec("l_extendedprice") * dec("l_discount")
    is_credit = F.col("l_returnflag") == "R"
    s = li.groupBy("l_orderkey").agg(
        F.nullif(F.sum(F.when(~is_credit, amt).otherwise(F.lit(0))), F.lit(0)).alias("debit"),
        F.nullif(F.sum(F.when(is_credit, amt).otherwise(F.lit(0))), F.lit(0)).alias("credit"))
    key = F.col("l_orderkey").cast("string")
    return s.select("l_orderkey", F.col("debit").cast("double").alias("debit"),
                    F.col("credit").cast("double").alias("credit"),
                    F.when(F.col("debit").isNull(), "").otherwise(F.concat(F.lit("Debe "), key)).alias("debit_name"),
                    F.when(F.col("credit").isNull(), "").otherwise(F.concat(F.lit("Haber "), key)).alias("credit_name"))


def _words_sql(amount: str, currency: str) -> str:
    """Independent SQL spelling of amounts (oracle for ``amount_in_words``)."""
    return f"""
  CASE WHEN {amount} IS NULL THEN NULL
       WHEN abs({amount}) > {MAX_AMOUNT} THEN '---'
       WHEN {currency} NOT IN (1, 2) THEN NULL
       ELSE (SELECT CASE WHEN sgn THEN '-' ELSE '' END
                    || ltrim(CASE WHEN whole = 0 THEN ' cero' ELSE g1.w || g2.w || g3.w END)
                    || CASE WHEN cents > 0 THEN ' ' || cur || ' con ' || CAST(cents AS VARCHAR) || '/100'
                            ELSE ' ' || cur || ' exactos' END
             FROM (SELECT whole, cents, sgn, cur, whole // 1000000 AS n1, (whole // 1000) % 1000 AS n2, whole % 1000 AS n3
                   FROM (SELECT c // 100 AS whole, c % 100 AS cents, sgn,
                                CASE WHEN {currency} = 1 THEN '{CURRENCIES[1]}' ELSE '{CURRENCIES[2]}' END AS cur
                         FROM (SELECT CAST(abs(CAST({amount} AS DECIMAL(12,2))) * 100 AS BIGINT) AS c,
                                      CAST({amount} AS DECIMAL(12,2)) < 0 AS sgn))) x
             JOIN grp g1 ON g1.pos = 1 AND g1.n = x.n1
             JOIN grp g2 ON g2.pos = 2 AND g2.n = x.n2
             JOIN grp g3 ON g3.pos = 3 AND g3.n = x.n3)
  END"""


_GROUPS_SQL = f"""grp AS (
  SELECT pos, n,
    (CASE WHEN n >= 100 THEN CASE WHEN n // 100 = 1 THEN CASE WHEN n % 100 = 0 THEN ' cien' ELSE ' ciento' END
                                  ELSE ' ' || {_sql_list(HUNDREDS)}[n // 100] END ELSE '' END) ||
    (CASE WHEN n % 100 = 0 THEN ''
          WHEN n % 100 < 30 THEN CASE WHEN pos = 3 AND n % 100 = 21 THEN ' veintiuno'
                                      WHEN pos = 2 AND n = 1 THEN ''
                                      ELSE ' ' || {_sql_list(UNITS)}[n % 100] END
          ELSE ' ' || {_sql_list(TENS)}[(n % 100) // 10] ||
               CASE WHEN pos = 3 AND n % 10 = 1 THEN ' y uno'
                    WHEN n % 10 <> 0 THEN ' y ' || {_sql_list(UNITS)}[n % 10] ELSE '' END END) ||
    (CASE WHEN n = 0 THEN '' WHEN pos = 1 THEN CASE WHEN n = 1 THEN ' millón' ELSE ' millones' END
          WHEN pos = 2 THEN ' mil' ELSE '' END) AS w
  FROM range(0, 1000) r(n), (VALUES (1), (2), (3)) p(pos))"""


@report("amount_words", "E26 F1 E13 E35 E36 J1 R28 R31", sql=f"""
WITH {_GROUPS_SQL},
d AS (SELECT o_orderkey, o_orderdate, o_totalprice, c_acctbal,
             CASE WHEN o_orderpriority < '3' THEN 1 ELSE 2 END AS currency
      FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, currency,
       lpad(CAST(day(o_orderdate) AS VARCHAR), 2, '0') || ' de ' || {_MES}[month(o_orderdate)] || ' del ' || CAST(year(o_orderdate) AS VARCHAR) AS long_date,
       {_words_sql('o_totalprice', 'currency')} AS amount_words,
       {_words_sql('c_acctbal', '1')} AS balance_words
FROM d
""")
def amount_words(spark, root):
    """Cheque lines: payment date in words and amounts spelled out in the document currency."""
    t = Tables(spark, root)
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "o_orderdate", "o_totalprice", "c_acctbal",
        F.when(F.col("o_orderpriority") < "3", 1).otherwise(2).alias("currency"))
    return d.select("o_orderkey", "currency", long_date_es("o_orderdate").alias("long_date"),
                    amount_in_words(F.col("o_totalprice"), F.col("currency")).alias("amount_words"),
                    amount_in_words(F.col("c_acctbal"), 1).alias("balance_words"))
