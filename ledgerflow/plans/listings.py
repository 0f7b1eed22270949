"""Listings with all their rows: point-of-sale sessions, loan collections, packing list,
budget lines (report jobs R09, R29, R30, R46)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerflow.functions.dates import as_date
from ledgerflow.functions.money import dec, ratio
from ledgerflow.functions.predicates import date_between, in_list
from ledgerflow.operators import scan
from ledgerflow.plans.common import SQL_SIGNED, STATUS_LABELS, decode, signed_amount, sql_decode
from ledgerflow.plans.financial import BIG_SIZE
from ledgerflow.plans.ledger import LINE_ORDER
from ledgerflow.plans.operations import CL_FROM, CL_LATE, CL_RATE, CL_TO, POS_FROM, POS_STATIONS, POS_TO
from ledgerflow.plans.pivots import PLAN_FACTOR
from ledgerflow.plans.registry import report
from ledgerflow.sources import Tables


@report("pos_sessions", "R29 J5 J20 P1 P2 E1 Q9", sql=f"""
WITH ord AS (SELECT l_orderkey AS k, l_partkey AS p, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2)
SELECT o_orderpriority || '/' || strftime(o_orderdate, '%Y-%m-%d') AS session, o_orderkey, c_name AS customer,
       {sql_decode('o_orderstatus', STATUS_LABELS)} AS state, l_linenumber, l_partkey, l_quantity,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS total, COALESCE(n, 0) AS n_order_lines
FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'N'
LEFT JOIN ord ON k = l_orderkey AND p = l_partkey
WHERE o_orderpriority IN {POS_STATIONS} AND CAST(o_orderdate AS DATE) BETWEEN DATE '{POS_FROM}' AND DATE '{POS_TO}'
""")
def pos_sessions(spark, root, stations=POS_STATIONS, start=POS_FROM, end=POS_TO):
    """Rows of the point-of-sale close, by session, document and line: every invoiced line once,
    with the number of its document's order lines of the same product (0 if none) in place of
    the repeated rows of a join by document."""
    t = Tables(spark, root)
    docs = (t.orders.where(in_list("o_orderpriority", stations) & date_between("o_orderdate", start, end))
             .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
             .select("o_orderkey", "c_name", "o_orderstatus", "o_totalprice",
                     F.concat("o_orderpriority", F.lit("/"), as_date("o_orderdate").cast("string")).alias("session")))
    lines = t.lineitem.join(docs.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    ordered = lines.where("l_returnflag <> 'N'").groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    rows = (t.lineitem.where("l_returnflag = 'N'").join(docs, F.col("l_orderkey") == F.col("o_orderkey"))
             .join(ordered, ["l_orderkey", "l_partkey"], "left"))
    return rows.select("session", "o_orderkey", F.col("c_name").alias("customer"),
                       decode(F.col("o_orderstatus"), STATUS_LABELS).alias("state"), "l_linenumber", "l_partkey", "l_quantity",
                       dec("o_totalprice").cast("double").alias("total"), F.coalesce("n", F.lit(0)).alias("n_order_lines")
                       ).orderBy("session", "o_orderkey", "l_linenumber", "l_partkey", "l_quantity")


CO_INSURANCE = 0.5          # per cent of the loan


@report("loan_collections", "R30 E24 E19 E29 E30 J1 P1 O1", sql=f"""
WITH d AS (SELECT o_orderkey, c_name, CAST(o_orderdate AS DATE) AS due, CAST(c_acctbal AS DECIMAL(18,2)) AS balance,
                  CAST(o_totalprice AS DECIMAL(18,2)) * CAST({CL_RATE} / 1200 AS DECIMAL(9,6)) AS interest,
                  CAST(o_totalprice AS DECIMAL(18,2)) * CAST({CO_INSURANCE} / 100 AS DECIMAL(9,6)) AS insurance,
                  CAST(o_totalprice AS DECIMAL(18,2)) * CAST({CL_RATE} / 100 * {CL_LATE} / 100 AS DECIMAL(9,6)) AS late_fee
           FROM orders JOIN customer ON o_custkey = c_custkey
           WHERE o_orderstatus = 'O' AND CAST(o_orderdate AS DATE) BETWEEN DATE '{CL_FROM}' AND DATE '{CL_TO}')
SELECT o_orderkey, c_name, due,
       CASE WHEN balance < 0 THEN 0.0 WHEN balance >= 0 THEN ROUND(CAST(balance AS DOUBLE) / NULLIF(CAST(interest + insurance AS DOUBLE), 0), 4) END AS factor,
       CAST(interest AS DOUBLE) AS interest, CAST(insurance AS DOUBLE) AS insurance, CAST(late_fee AS DOUBLE) AS late_fee,
       CAST(interest + insurance + late_fee AS DOUBLE) AS with_late_fee, CAST(interest + insurance AS DOUBLE) AS instalment,
       CAST(balance AS DOUBLE) AS balance
FROM d
""")
def loan_collections(spark, root, start=CL_FROM, end=CL_TO, state="O", rate=CL_RATE, late=CL_LATE, insurance=CO_INSURANCE):
    """Loans of one state due in a period, highest overdue factor first: the factor (0 for a
    negative balance, else balance over the instalment; NULL for an instalment of 0), the
    instalment's interest and insurance, the late fee and both fee sums."""
    t = Tables(spark, root)
    part = lambda share: dec("o_totalprice") * F.lit(share).cast("decimal(9,6)")
    d = (t.orders.where((F.col("o_orderstatus") == state) & date_between("o_orderdate", start, end))
          .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
          .select("o_orderkey", "c_name", as_date("o_orderdate").alias("due"), dec("c_acctbal").alias("balance"),
                  part(rate / 1200).alias("interest"), part(insurance / 100).alias("insurance"),
                  part(rate / 100 * late / 100).alias("late_fee")))
    both = F.col("interest") + F.col("insurance")
    factor = F.when(F.col("balance") < 0, F.lit(0.0)).when(F.col("balance") >= 0, ratio("balance", both))
    money = lambda c, name: c.cast("double").alias(name)
    return d.select("o_orderkey", "c_name", "due", factor.alias("factor"), money(F.col("interest"), "interest"),
                    money(F.col("insurance"), "insurance"), money(F.col("late_fee"), "late_fee"),
                    money(both + F.col("late_fee"), "with_late_fee"), money(both, "instalment"),
                    money(F.col("balance"), "balance")).orderBy(F.col("factor").desc(), "o_orderkey")


PL_FROM, PL_TO = dt.date(1995, 1, 1), dt.date(2001, 12, 31)
PL_ORDER = ["l_orderkey", *LINE_ORDER]


@report("packing_list", "R46 W6 E15 J1 J6 P1 O1", sql=f"""
SELECT l_orderkey, CAST(o_orderdate AS DATE) AS day, s_name AS exporter, c_name AS consignee, sn.n_name AS origin, cn.n_name AS destination,
       row_number() OVER (ORDER BY {", ".join(PL_ORDER)}) || '. ' || p_name AS product,
       CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS lot, CAST(l_shipdate AS DATE) AS shipped, l_quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN part ON l_partkey = p_partkey
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '{PL_FROM}' AND DATE '{PL_TO}'
""")
def packing_list(spark, root, start=PL_FROM, end=PL_TO):
    """Packing list: the lines of a period's documents with exporter, consignee, both countries,
    lot and product, numbered through the whole list by document and line. Lines without one of
    these are left out before the numbering."""
    t = Tables(spark, root)
    nation = lambda key, name: t.nation.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(name))
    docs = (t.orders.where(date_between("o_orderdate", start, end)).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
             .join(nation("c_nationkey", "destination"), "c_nationkey")
             .select("o_orderkey", as_date("o_orderdate").alias("day"), F.col("c_name").alias("consignee"), "destination"))
    sup = t.supplier.join(nation("s_nationkey", "origin"), "s_nationkey").select("s_suppkey", F.col("s_name").alias("exporter"), "origin")
    rows = (t.lineitem.join(docs, F.col("l_orderkey") == F.col("o_orderkey")).join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
             .join(t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
             .select(*PL_ORDER, "day", "exporter", "consignee", "origin", "destination", "p_name"))
    keep = ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "day", "exporter", "consignee", "origin", "destination", "p_name"]
    n = scan.number_rows(rows, PL_ORDER, "line_no", keep, scan.plan_chunks(spark, t.lineitem.count()))     # counted from the files' footers
    text = lambda c: F.col(c).cast("string")
    return n.select(                    # in the order of the list already
        "l_orderkey", "day", "exporter", "consignee", "origin", "destination",
        F.concat(F.col("line_no").cast("long").cast("string"), F.lit(". "), "p_name").alias("product"),
        F.concat(text("l_partkey"), F.lit("-"), text("l_suppkey")).alias("lot"), as_date("l_shipdate").alias("shipped"), "l_quantity")


@report("budget_lines", "R09 A21 J2 J7 A2 B1 B2 Q7", sql=f"""
WITH plan AS (SELECT p_type, p_brand, SUM(CAST(p_retailprice AS DECIMAL(18,2))) * {PLAN_FACTOR} AS planned FROM part GROUP BY ALL),
act AS (SELECT l_partkey, -SUM({SQL_SIGNED}) AS actual FROM lineitem GROUP BY l_partkey),
bridge AS (SELECT p_partkey AS acc, 'T_' || p_type AS tag FROM part UNION ALL SELECT p_partkey, 'T_BIG' FROM part WHERE p_size > {BIG_SIZE}),
r AS (SELECT p_type AS parent, p_brand AS child, tag, p_partkey AS account, p_name AS name, planned, COALESCE(actual, 0) AS actual
      FROM plan JOIN part USING (p_type, p_brand) JOIN bridge ON acc = p_partkey LEFT JOIN act ON l_partkey = p_partkey),
v AS (SELECT *, CASE WHEN actual = 0 THEN 0 ELSE CAST(ROUND(CAST(planned AS DOUBLE) / CAST(actual AS DOUBLE), 4) AS DECIMAL(28,4)) END AS share FROM r)
SELECT CASE GROUPING(parent, child, tag, account, name) WHEN 0 THEN 0 WHEN 15 THEN 1 ELSE 2 END AS level,
       parent, child, tag, account, name, CAST(SUM(planned) AS DOUBLE) AS planned, CAST(SUM(actual) AS DOUBLE) AS actual,
       CAST(SUM(share) AS DOUBLE) AS planned_over_actual
FROM v GROUP BY GROUPING SETS ((parent, child, tag, account, name), (parent), ())
""")
def budget_lines(spark, root):
    """Budget lines by account: planned amount of the line, actual amount of the account (credit -
    debit, 0 when none) and planned over actual (0 when nothing was posted, as the report gives
    it), each account under its tags, with totals by parent (``level`` 1) and overall (2). The
    sums of ratios are the report's own totals."""
    t = Tables(spark, root)
    plan = t.part.groupBy("p_type", "p_brand").agg((F.sum(dec("p_retailprice")) * PLAN_FACTOR).alias("planned"))
    act = t.lineitem.groupBy("l_partkey").agg((-F.sum(signed_amount())).alias("actual"))
    tags = F.array_compact(F.array(F.concat(F.lit("T_"), "p_type"), F.when(F.col("p_size") > BIG_SIZE, F.lit("T_BIG"))))
    accounts = t.part.select("p_type", "p_brand", "p_partkey", "p_name", F.explode(tags).alias("tag"))
    actual = F.coalesce("actual", F.lit(0))
    share = F.when(actual == 0, F.lit(0)).otherwise(ratio("planned", actual).cast("decimal(28,4)"))
    rows = (accounts.join(plan, ["p_type", "p_brand"]).join(act, F.col("l_partkey") == F.col("p_partkey"), "left")
            .select(F.col("p_type").alias("parent"), F.col("p_brand").alias("child"), "tag", F.col("p_partkey").alias("account"),
                    F.col("p_name").alias("name"), "planned", actual.alias("actual"), share.alias("share")))
    keys = [F.col(c) for c in ("parent", "child", "tag", "account", "name")]
    level = F.when(F.grouping_id() == 0, 0).when(F.grouping_id() == 15, 1).otherwise(2)
    money = lambda c, name: F.sum(c).cast("double").alias(name)
    return (rows.groupingSets([keys, keys[:1], []], *keys)
            .agg(level.alias("level"), money("planned", "planned"), money("actual", "actual"), money("share", "planned_over_actual"))
            .orderBy(F.col("level"), F.col("account"), "tag", "parent"))
