"""Predicate-centred reports: ranges, collections, optional keys, open items, value lists."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerflow.functions.dates import as_date, days_between
from ledgerflow.functions.money import dec, out, ratio
from ledgerflow.functions.predicates import date_between, in_list, one_of
from ledgerflow.operators import scan
from ledgerflow.operators.totals import cross_scalar
from ledgerflow.plans.common import PRIORITY_LABELS, STATUS_LABELS, decode, sql_decode
from ledgerflow.plans.registry import report
from ledgerflow.sources import Tables, values

RANGE_FROM, RANGE_TO = dt.date(1997, 3, 1), dt.date(1999, 6, 30)
NATIONS = (1, 3, 5, 7, 11, 13, 17, 19, 23)


@report("date_range_in_list", "P1 P2 P5 P12 J1", sql=f"""
SELECT o_orderkey, c_name, CAST(o_orderdate AS DATE) AS order_date, o_orderstatus,
       CAST(ROUND(CAST(o_totalprice AS DECIMAL(18,2)), 2) AS DOUBLE) AS amount
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '{RANGE_FROM}' AND DATE '{RANGE_TO}'
  AND c_nationkey IN {NATIONS}
  AND o_orderstatus IN ('F', 'O')
  AND o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED')
""")
def date_range_in_list(spark, root, date_from=RANGE_FROM, date_to=RANGE_TO, nations=NATIONS,
                       states=("F", "O"), skip_priorities=("5-LOW", "4-NOT SPECIFIED")):
    """Documents in an inclusive date range, of partners in a collection, in given states."""
    t = Tables(spark, root)
    o = t.orders.where(date_between("o_orderdate", date_from, date_to)
                       & in_list("o_orderstatus", states)
                       & ~F.col("o_orderpriority").isin(list(skip_priorities)))
    c = t.customer.where(in_list("c_nationkey", nations)).select("c_custkey", "c_name")
    return (o.join(c, o.o_custkey == c.c_custkey)
             .select("o_orderkey", "c_name", as_date("o_orderdate").alias("order_date"),
                     "o_orderstatus", out(dec("o_totalprice")).alias("amount")))


OPT_NATION_ID, OPT_NATION_NAME = 0, "NATION_7"


@report("optional_key_predicate", "P4 P3 J1", sql=f"""
SELECT o_orderkey, o_custkey, n_name,
       CAST(ROUND(CAST(o_totalprice AS DECIMAL(18,2)), 2) AS DOUBLE) AS amount
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE CASE WHEN COALESCE({OPT_NATION_ID}, 0) <> 0 THEN n_nationkey = {OPT_NATION_ID}
           ELSE n_name = '{OPT_NATION_NAME}' END
""")
def optional_key_predicate(spark, root, nation_id=OPT_NATION_ID, nation_name=OPT_NATION_NAME):
    """Documents of one partner group, chosen by id when given and non-zero, else by name."""
    t = Tables(spark, root)
    n = t.nation.where(one_of("n_nationkey", nation_id, "n_name", nation_name))
    c = t.customer.select("c_custkey", "c_nationkey")
    o = t.orders
    return (o.join(c, o.o_custkey == c.c_custkey)
             .join(n, F.col("c_nationkey") == F.col("n_nationkey"))  # nation: 25 rows
             .select("o_orderkey", "o_custkey", "n_name", out(dec("o_totalprice")).alias("amount")))


AS_OF = dt.date(2000, 1, 1)
COMPANY = "BUILDING"


@report("open_items", "P13 P10 E36 E8 J1 Q16", sql=f"""
SELECT o_orderkey, o_custkey,
       datediff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') AS age_days,
       CAST(ROUND(CAST(o_totalprice AS DECIMAL(18,2)), 2) AS DOUBLE) AS residual
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_mktsegment = '{COMPANY}' AND o_orderstatus = 'O'
  AND datediff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') >= 0
  AND o_totalprice > 0
""")
def open_items(spark, root, as_of=AS_OF, company=COMPANY):
    """Open documents of one company with a positive residual and non-negative age at ``as_of``."""
    t = Tables(spark, root)
    c = t.customer.where(F.col("c_mktsegment") == company).select("c_custkey")
    age = days_between(F.lit(as_of), "o_orderdate")
    o = t.orders.where((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 0)
                       & (as_date("o_orderdate") <= F.lit(as_of)))          # age >= 0, pushable form
    return (o.join(c, o.o_custkey == c.c_custkey)
             .select("o_orderkey", "o_custkey", age.alias("age_days"),
                     out(dec("o_totalprice")).alias("residual"))
             .where(F.col("age_days") >= 0))


CONTROL_DATE = dt.date(1998, 6, 30)
RATE = 7.8


@report("control_row_params", "S5 S6 P8 P6 J8 W1 R17", sql=f"""
WITH daily AS (
  SELECT CAST(o_orderdate AS DATE) AS day, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS day_total
  FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1),
snap AS (SELECT day, day_total, SUM(day_total) OVER (ORDER BY day) AS running_total FROM daily),
ctl AS (SELECT running_total AS ctl_total, {RATE} AS rate FROM snap WHERE day = DATE '{CONTROL_DATE}')
SELECT day, CAST(ROUND(day_total, 2) AS DOUBLE) AS day_total,
       CAST(ROUND(running_total, 2) AS DOUBLE) AS running_total,
       ROUND(CAST(day_total AS DOUBLE) / rate, 4) AS day_total_usd,
       ROUND(CAST(running_total AS DOUBLE) / CAST(ctl_total AS DOUBLE), 4) AS of_control
FROM snap, ctl
WHERE year(day) BETWEEN 1997 AND 1999 AND month(day) BETWEEN 3 AND 6
""")
def control_row_params(spark, root, control_date=CONTROL_DATE, rate=RATE):
    """Daily snapshot with running totals, read against a one-row control relation."""
    o = Tables(spark, root).orders.where(F.col("o_orderpriority").isNotNull())
    daily = o.groupBy(as_date("o_orderdate").alias("day")).agg(F.sum(dec("o_totalprice")).alias("day_total"))
    # One row per calendar day: the running total is a chunked scan over the day order.
    snap = scan.cumsum(scan.chunk_by_range(daily, [], ["day"]), F.col("day_total"), [], ["day"],
                       "running_total").drop(scan.CHUNK)
    ctl = (snap.where(F.col("day") == F.lit(control_date))
               .select(F.col("running_total").alias("ctl_total"), F.lit(rate).alias("rate")))
    res = cross_scalar(snap.where(F.year("day").between(1997, 1999) & F.month("day").between(3, 6)),
                       ctl)                                      # control relation: one row
    return res.select("day", out("day_total").alias("day_total"), out("running_total").alias("running_total"),
                      ratio(F.col("day_total"), F.col("rate")).alias("day_total_usd"),
                      ratio(F.col("running_total"), F.col("ctl_total")).alias("of_control"))


@report("top_recent", "O5 S7 A7 E18 O1 R47", sql="""
SELECT c_custkey, upper(c_name) AS label, CAST(max(o_orderdate) AS DATE) AS last_order
FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY c_custkey, upper(c_name)
ORDER BY last_order DESC, c_custkey
LIMIT 50
""")
def top_recent(spark, root, n=50):
    """Value list for a choice box: the ``n`` partners with the most recent documents."""
    t = Tables(spark, root)
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    g = j.groupBy("c_custkey", F.upper("c_name").alias("label")).agg(
        as_date(F.max("o_orderdate")).alias("last_order"))
    return g.orderBy(F.col("last_order").desc(), "c_custkey").limit(n)   # top-n is the feature


@report("numeric_text_sort", "O2 E7", sql="""
SELECT p_partkey, code,
       row_number() OVER (ORDER BY CAST(code AS DECIMAL(38,0)), p_partkey) AS sort_pos
FROM (SELECT p_partkey, substr(p_brand, 7) || lpad(CAST(p_size AS VARCHAR), 2, '0') AS code FROM part)
""")
def numeric_text_sort(spark, root):
    """Accounts ordered by a digit code stored as text, compared as a number."""
    p = Tables(spark, root).part.select(
        "p_partkey", F.concat(F.expr("substring(p_brand, 7)"), F.lpad(F.col("p_size").cast("string"), 2, "0")).alias("code"))
    order = [F.col("code").cast("decimal(38,0)"), F.col("p_partkey")]
    d = scan.chunk_by_range(p.withColumn("_num", order[0]), [], ["_num", "p_partkey"])
    d = scan.cumsum(d, F.lit(1), [], ["_num", "p_partkey"], "sort_pos")
    return d.select("p_partkey", "code", F.col("sort_pos").cast("long").alias("sort_pos"))


# Users that are no sellers; the choice whether a sale is on credit.
SYSTEM_USERS = [6, 1]
YES_NO = [("si", "Si"), ("no", "No")]

_LISTS_SQL = {
    "pais": "SELECT CAST(n_nationkey AS VARCHAR) AS id, upper(n_name) AS label, CAST(n_regionkey AS VARCHAR) AS parent FROM nation",
    "region": "SELECT CAST(r_regionkey AS VARCHAR), upper(r_name), CAST(NULL AS VARCHAR) FROM region",
    "cliente": "SELECT CAST(c_custkey AS VARCHAR), upper(trim(c_name)), CAST(c_nationkey AS VARCHAR) FROM customer",
    "proveedor": "SELECT CAST(s_suppkey AS VARCHAR), upper(trim(s_name)), CAST(s_nationkey AS VARCHAR) FROM supplier",
    "tipo": "SELECT p_type, upper(p_type), CAST(NULL AS VARCHAR) FROM part",
    "marca": "SELECT p_brand, upper(p_brand), p_type FROM part",
    "segmento": "SELECT c_mktsegment, upper(c_mktsegment), CAST(NULL AS VARCHAR) FROM customer",
    "estado": f"SELECT o_orderstatus, {sql_decode('o_orderstatus', STATUS_LABELS)}, CAST(NULL AS VARCHAR) FROM orders",
    "diario": f"SELECT o_orderpriority, {sql_decode('o_orderpriority', PRIORITY_LABELS)}, CAST(NULL AS VARCHAR) FROM orders",
    "anio": "SELECT CAST(year(o_orderdate) AS VARCHAR), CAST(year(o_orderdate) AS VARCHAR), CAST(NULL AS VARCHAR) FROM orders",
    "mes": "SELECT strftime(o_orderdate, '%Y-%m'), strftime(o_orderdate, '%m/%Y'), CAST(year(o_orderdate) AS VARCHAR) FROM orders",
    "documento": "SELECT CAST(o_orderkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), o_orderpriority FROM orders",
    "cheque": ("SELECT CAST(o_orderkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), CAST(c_nationkey AS VARCHAR) "
               "FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'"),
    "vendedor": ("SELECT CAST(s_suppkey AS VARCHAR), s_name, CAST(NULL AS VARCHAR) "
                 "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_suppkey NOT IN (6, 1)"),
    "credito": "SELECT 'si', 'Si', CAST(NULL AS VARCHAR) UNION SELECT 'no', 'No', CAST(NULL AS VARCHAR)",
}


@report("filter_lists", "S7 R47 O1 E18 A6", sql="\nUNION ALL ".join(
    f"SELECT DISTINCT '{name}' AS list, id, label, parent FROM ({sql}) x(id, label, parent) WHERE id IS NOT NULL"
    for name, sql in _LISTS_SQL.items()))
def filter_lists(spark, root, names=None, parent=None):
    """Value lists for choice boxes: distinct (id, label) by label, each with the id of the
    list above it for cascading choices (countries of a region, partners of a country, brands
    of a type, months of a year, documents of a journal, cheques of a bank), the
    sellers that occur on invoice lines, without the system users, and the yes/no list. ``names`` picks lists, ``parent`` the children of one value."""
    t = Tables(spark, root)
    no, text = F.lit(None).cast("string"), lambda c: F.col(c).cast("string")
    year = F.year("o_orderdate").cast("string")
    lists = {
        "pais": (t.nation, text("n_nationkey"), F.upper("n_name"), text("n_regionkey")),
        "region": (t.region, text("r_regionkey"), F.upper("r_name"), no),
        "cliente": (t.customer, text("c_custkey"), F.upper(F.trim("c_name")), text("c_nationkey")),
        "proveedor": (t.supplier, text("s_suppkey"), F.upper(F.trim("s_name")), text("s_nationkey")),
        "tipo": (t.part, F.col("p_type"), F.upper("p_type"), no),
        "marca": (t.part, F.col("p_brand"), F.upper("p_brand"), F.col("p_type")),
        "segmento": (t.customer, F.col("c_mktsegment"), F.upper("c_mktsegment"), no),
        "estado": (t.orders, F.col("o_orderstatus"), decode(F.col("o_orderstatus"), STATUS_LABELS), no),
        "diario": (t.orders, F.col("o_orderpriority"), decode(F.col("o_orderpriority"), PRIORITY_LABELS), no),
        "anio": (t.orders, year, year, no),
        "mes": (t.orders, F.date_format("o_orderdate", "yyyy-MM"), F.date_format("o_orderdate", "MM/yyyy"), year),
    }
    paid = t.orders.where("o_orderstatus = 'F'").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    lists |= {"documento": (t.orders, text("o_orderkey"), text("o_orderkey"), F.col("o_orderpriority")),
              "cheque": (paid, text("o_orderkey"), text("o_orderkey"), text("c_nationkey"))}
    sold = t.lineitem.where(~F.col("l_suppkey").isin(SYSTEM_USERS)).select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    lists |= {"vendedor": (t.supplier.join(sold, "s_suppkey", "left_semi"), text("s_suppkey"), F.col("s_name"), no),
              "credito": (values(spark, YES_NO, "id string, label string"), F.col("id"), F.col("label"), no)}
    out = None
    for name, (df, key, label, above) in lists.items():
        if names and name not in names:
            continue
        one = df.select(key.alias("id"), label.alias("label"), above.alias("parent")).where("id IS NOT NULL")
        one = (one if parent is None else one.where(F.col("parent") == str(parent))).distinct()
        one = one.select(F.lit(name).alias("list"), "id", "label", "parent")
        out = one if out is None else out.unionByName(one)
    return out.orderBy("list", "label", "id", "parent")
