"""Logistics, retail and loan documents (report jobs R03/R04, R25, R27-R30, R34, R37, R39, R40)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerflow.functions.dates import as_date, days_between, long_date_es
from ledgerflow.functions.money import dec, out, ratio
from ledgerflow.functions.predicates import date_between, in_list, one_of
from ledgerflow.functions.text import key_after
from ledgerflow.functions.words import amount_in_words
from ledgerflow.operators.nest import exclusive_rows, master_detail
from ledgerflow.operators.pivot import cell, wide_pivot
from ledgerflow.plans.columns import _GROUPS_SQL, _MES, _words_sql
from ledgerflow.plans.common import SQL_LINE_AMOUNT, line_amount
from ledgerflow.plans.documents import union_branches
from ledgerflow.plans.joins import CURRENCY_OF_FLAG
from ledgerflow.plans.ledger import LINE_ORDER
from ledgerflow.plans.pivots import PROPERTY_PREFIX, TIE_BREAK, property_table
from ledgerflow.plans.registry import report
from ledgerflow.sources import Tables

TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
_LAST_ORDER = ", ".join(c + " DESC" for c in TIE_BREAK)


@report("container_costs", "R03 R04 A11 A15 A19 J14 J19 E8 E15 Q17", sql=f"""
WITH l AS (
  SELECT l_orderkey, p_type, CAST(l_extendedprice AS DECIMAL(18,2)) AS cost, l_returnflag,
         {", ".join(TIE_BREAK)},
         row_number() OVER (PARTITION BY l_orderkey, p_type ORDER BY {_LAST_ORDER}) AS rn
  FROM lineitem JOIN part ON l_partkey = p_partkey),
w AS (
  SELECT l_orderkey,
         {", ".join(f"SUM(cost) FILTER (WHERE p_type = '{t}') AS sum_{t.lower()}" for t in TYPES)},
         {", ".join(f"max(cost) FILTER (WHERE p_type = '{t}' AND rn = 1) AS last_{t.lower()}" for t in TYPES)},
         {", ".join(f"SUM(cost) FILTER (WHERE l_returnflag = '{f}') AS total_{c}" for f, c in CURRENCY_OF_FLAG)}
  FROM l GROUP BY l_orderkey),
d AS (SELECT DISTINCT l_orderkey AS k, min(l_shipdate) OVER (PARTITION BY l_orderkey) AS first_ship,
             max(l_shipdate) OVER (PARTITION BY l_orderkey) AS last_ship FROM lineitem)
SELECT 'CONT-' || CAST(o_orderkey AS VARCHAR) AS container,
       datediff('day', CAST(o_orderdate AS DATE), CAST(first_ship AS DATE)) AS days_to_first,
       datediff('day', CAST(o_orderdate AS DATE), CAST(last_ship AS DATE)) AS days_to_last,
       {", ".join(f"CAST(COALESCE(sum_{t.lower()}, 0) AS DOUBLE) AS sum_{t.lower()}" for t in TYPES)},
       {", ".join(f"CAST(last_{t.lower()} AS DOUBLE) AS last_{t.lower()}" for t in TYPES)},
       {", ".join(f"CAST(COALESCE(total_{c}, 0) AS DOUBLE) AS total_{c}" for _, c in CURRENCY_OF_FLAG)}
FROM orders JOIN w ON o_orderkey = w.l_orderkey JOIN d ON o_orderkey = d.k
""")
def container_costs(spark, root):
    """Container costs: per container the summed cost of each cost type, the last recorded
    cost of each type (a crosstab cell without aggregation, full tie-break), totals per
    currency, and days from arrival to the first and last movement."""
    t = Tables(spark, root)
    l = t.lineitem.join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")) \
                  .withColumn("cost", dec("l_extendedprice"))
    # one aggregation: summed and last cost per type, totals per currency, first/last date
    g = l.groupBy("l_orderkey").agg(
        *[F.coalesce(cell("p_type", x, "cost"), F.lit(0)).alias(f"sum_{x.lower()}") for x in TYPES],
        *[cell("p_type", x, "cost", agg="last", order=TIE_BREAK).alias(f"last_{x.lower()}") for x in TYPES],
        *[F.coalesce(cell("l_returnflag", f, "cost"), F.lit(0)).alias(f"total_{c}") for f, c in CURRENCY_OF_FLAG],
        F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
    j = t.orders.select("o_orderkey", "o_orderdate").join(g, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select(F.concat(F.lit("CONT-"), F.col("o_orderkey").cast("string")).alias("container"),
                    days_between("first_ship", "o_orderdate").alias("days_to_first"),
                    days_between("last_ship", "o_orderdate").alias("days_to_last"),
                    *[F.col(f"sum_{x.lower()}").cast("double").alias(f"sum_{x.lower()}") for x in TYPES],
                    *[F.col(f"last_{x.lower()}").cast("double").alias(f"last_{x.lower()}") for x in TYPES],
                    *[F.col(f"total_{c}").cast("double").alias(f"total_{c}") for _, c in CURRENCY_OF_FLAG])


LOT_AS_OF = dt.date(2001, 12, 31)


@report("lot_inventory", "R39 E2 E8 J1 J2 J4 A1 P11 Q11", sql=f"""
WITH entered AS (SELECT l_orderkey, l_partkey, l_suppkey, SUM(l_quantity) AS entered_qty
                 FROM lineitem GROUP BY 1, 2, 3),
pending AS (SELECT l_orderkey, l_partkey, l_suppkey, SUM(l_quantity) AS packages,
                   SUM(l_quantity * p_size) AS weight
            FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'O' GROUP BY 1, 2, 3)
SELECT e.l_orderkey, e.l_partkey, e.l_suppkey, entered_qty, packages, weight,
       CASE WHEN o_orderstatus = 'F' THEN 'Liberado'
            WHEN o_orderstatus = 'O' THEN CASE WHEN c_acctbal < 0 THEN 'Retenido' ELSE 'En bodega' END
            ELSE CASE WHEN packages = entered_qty THEN 'Sin despacho' ELSE 'Parcial' END END AS lot_status,
       datediff('day', CAST(o_orderdate AS DATE), DATE '{LOT_AS_OF}') AS days_in_store
FROM entered e
JOIN pending p ON e.l_orderkey = p.l_orderkey AND e.l_partkey = p.l_partkey AND e.l_suppkey = p.l_suppkey
JOIN orders ON o_orderkey = e.l_orderkey LEFT JOIN customer ON o_custkey = c_custkey
WHERE packages > 0
""")
def lot_inventory(spark, root, as_of=LOT_AS_OF):
    """Fiscal warehouse inventory by lot (document, product, supplier): entered quantity,
    pending packages and weight joined on the three-part lot key, a status derived from
    three tables, and days in store at ``as_of``; only lots with pending packages."""
    t = Tables(spark, root)
    key = ["l_orderkey", "l_partkey", "l_suppkey"]
    entered = t.lineitem.groupBy(*key).agg(F.sum("l_quantity").alias("entered_qty"))
    pending = (t.lineitem.where(F.col("l_linestatus") == "O")
                         .join(t.part.select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
                         .groupBy(*key).agg(F.sum("l_quantity").alias("packages"),
                                            F.sum(F.col("l_quantity") * F.col("p_size")).alias("weight"))
                         .where(F.col("packages") > 0))
    j = (entered.join(pending, key)
                .join(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"),
                      F.col("l_orderkey") == F.col("o_orderkey"))
                .join(t.customer.select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"), "left"))
    st = F.col("o_orderstatus")
    status = (F.when(st == "F", "Liberado")
               .when(st == "O", F.when(F.col("c_acctbal") < 0, "Retenido").otherwise("En bodega"))
               .otherwise(F.when(F.col("packages") == F.col("entered_qty"), "Sin despacho").otherwise("Parcial")))
    return j.select(*key, "entered_qty", "packages", "weight", status.alias("lot_status"),
                    days_between(F.lit(as_of), "o_orderdate").alias("days_in_store"))


@report("owner_profit", "R40 J11 S4 E25 A22 J2 Q13 Q19", sql=f"""
WITH prop AS (SELECT '{PROPERTY_PREFIX}' || CAST(p_partkey AS VARCHAR) AS res_id,
                     ROUND(CAST(p_retailprice AS DECIMAL(18,2)) * 0.60, 2) AS cost FROM part),
sold AS (SELECT * FROM lineitem l
         WHERE NOT EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l.l_orderkey
                           AND l2.l_partkey = l.l_partkey AND l2.l_suppkey <> l.l_suppkey))
SELECT COALESCE(s_name, 'Sin dueño') AS owner, l_partkey,
       SUM(l_quantity) AS qty, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
       CAST(SUM(CAST(l_quantity AS DECIMAL(18,2)) * cost) AS DOUBLE) AS cost,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) - SUM(CAST(l_quantity AS DECIMAL(18,2)) * cost) AS DOUBLE) AS profit
FROM sold LEFT JOIN supplier ON l_suppkey = s_suppkey
JOIN prop ON TRY_CAST(substr(res_id, {len(PROPERTY_PREFIX) + 1}) AS BIGINT) = l_partkey
GROUP BY 1, 2
""")
def owner_profit(spark, root, owners=None):
    """Profit by owner and product, leaving out a sale when the same product of the same
    receipt was also sold from another location (NOT EXISTS on two keys plus a residual,
    as a per-group aggregate);
    cost from the typed property relation; missing owners labelled."""
    t = Tables(spark, root)
    sold = exclusive_rows(t.lineitem, ["l_orderkey", "l_partkey"], "l_suppkey").where(in_list("l_suppkey", owners))
    prop = property_table(t).where(F.col("name") == "standard_price")
    j = (sold.join(t.supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
             .join(prop, key_after("res_id", len(PROPERTY_PREFIX) + 1) == F.col("l_partkey")))
    g = j.groupBy(F.coalesce("s_name", F.lit("Sin dueño")).alias("owner"), "l_partkey").agg(
        F.sum("l_quantity").alias("qty"), F.sum(dec("l_extendedprice")).alias("revenue"),
        F.sum(dec("l_quantity") * F.col("value_float")).alias("cost"))
    return g.orderBy("owner", "l_partkey").select(
        "owner", "l_partkey", "qty", F.col("revenue").cast("double").alias("revenue"),
        F.col("cost").cast("double").alias("cost"), (F.col("revenue") - F.col("cost")).cast("double").alias("profit"))


def _union_sql() -> str:
    from ledgerflow.plans.registry import REGISTRY
    return REGISTRY["union_branches"].sql


@report("slips_by_type", "R25 O6 A18 E27 E28", sql="""
WITH u AS ({union}),
p AS (SELECT source,
             SUM(amount) FILTER (WHERE doc_type = 'Factura') AS factura,
             SUM(amount) FILTER (WHERE doc_type = 'Recibo') AS recibo, count(*) AS n_docs
      FROM u GROUP BY source)
SELECT source, CAST(ROUND(COALESCE(factura, 0), 2) AS DOUBLE) AS factura,
       CAST(ROUND(COALESCE(recibo, 0), 2) AS DOUBLE) AS recibo, n_docs FROM p
""".format(union=_union_sql()))
def slips_by_type(spark, root):
    """Deposit slips from three stacked sources, crosstabbed by source x document type."""
    u = union_branches(spark, root).withColumn("amount", dec("amount"))
    p = wide_pivot(u, ["source"], "doc_type", [("Factura", "factura"), ("Recibo", "recibo")], "amount",
                   extra=[F.count(F.lit(1)).alias("n_docs")])
    return p.select("source", out("factura").alias("factura"), out("recibo").alias("recibo"), "n_docs")


@report("slip_reconciliation", "R27 A20 A18 O6", sql=f"""
WITH d AS (SELECT l_orderkey, l_returnflag AS concept, ROUND({SQL_LINE_AMOUNT} * (1 + CAST(l_tax AS DECIMAL(18,2))), 2) AS amt
           FROM lineitem),
s AS (SELECT l_orderkey, SUM(amt) AS detail_total,
             {", ".join(f"SUM(amt) FILTER (WHERE concept = '{f}') AS concept_{f.lower()}" for f in "ANR")}
      FROM d GROUP BY l_orderkey)
SELECT o_orderkey, CASE WHEN CAST(o_totalprice AS DECIMAL(18,2)) <> detail_total THEN 'Revisar' ELSE 'Cuadrada' END AS status,
       {", ".join(f"CAST(COALESCE(concept_{f.lower()}, 0) AS DOUBLE) AS concept_{f.lower()}" for f in "ANR")}
FROM orders JOIN s ON o_orderkey = l_orderkey
""")
def slip_reconciliation(spark, root):
    """Slip reconciliation: declared amount against the sum of its detail (status), with the
    detail spread over concepts as columns; slips without detail do not appear."""
    t = Tables(spark, root)
    amount = F.round(line_amount() * (F.lit(1).cast("decimal(3,2)") + dec("l_tax")), 2)
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("concept"),
                              amount.alias("amt"))
    h = t.orders.select("o_orderkey", dec("o_totalprice").alias("declared"))
    # The detail total is one more aggregate of the same pass over the lines.
    c = wide_pivot(lines, ["o_orderkey"], "concept", [(f, f"concept_{f.lower()}") for f in "ANR"], "amt",
                   extra=[F.sum("amt").alias("detail")])
    j = h.join(c, "o_orderkey")
    status = F.when(F.col("declared") != F.col("detail"), "Revisar").otherwise("Cuadrada").alias("status")
    return j.select("o_orderkey", status, *[F.col(f"concept_{f.lower()}").cast("double").alias(f"concept_{f.lower()}")
                                              for f in "ANR"])


SC_FROM, SC_TO = dt.date(1995, 1, 1), dt.date(2001, 12, 31)
# Document types and the three stacked sources, the crosstab's two column groups.
SLIP_COLUMNS = [(t, c) for t in ("Factura", "Recibo") for c in ("abono", "cuota", "devolucion")]


@report("slip_crosstab", "R27 A17 A18 A20 O6 J2 P1 F3", sql="""
WITH u AS ({union}),
s AS (SELECT o_orderkey, SUM(CAST(amount AS DECIMAL(18,2))) AS collected, {cells}
      FROM u GROUP BY o_orderkey)
SELECT CAST(o_orderdate AS DATE) AS slip_date, o.o_orderkey, c_name AS client, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS deposited,
       CASE WHEN CAST(o_totalprice AS DECIMAL(18,2)) <> collected THEN 'requiere revision' ELSE 'cuadrado' END AS validation,
       {out}
FROM orders o JOIN s ON s.o_orderkey = o.o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '{lo}' AND DATE '{hi}'
""".format(union=_union_sql(), lo=SC_FROM, hi=SC_TO,
           cells=", ".join(f"SUM(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE doc_type = '{t}' AND source = '{c}') AS {t.lower()}_{c}"
                           for t, c in SLIP_COLUMNS),
           out=", ".join(f"CAST({t.lower()}_{c} AS DOUBLE) AS {t.lower()}_{c}" for t, c in SLIP_COLUMNS)))
def slip_crosstab(spark, root, start=SC_FROM, end=SC_TO):
    """Deposit slips of a period as a crosstab with two column groups: per slip (date, number,
    client, deposited amount, whether it equals what was collected) the amounts by document type
    and, inside it, by concept; a cell without lines is NULL. Slips without lines do not appear."""
    t = Tables(spark, root)
    u = union_branches(spark, root).withColumn("amount", dec("amount"))
    pair = F.concat_ws("/", "doc_type", "source")
    s = wide_pivot(u, ["o_orderkey"], pair, [(f"{t}/{c}", f"{t.lower()}_{c}") for t, c in SLIP_COLUMNS], "amount", fill=None,
                   extra=[F.sum("amount").alias("collected")])
    slips = t.orders.where(date_between("o_orderdate", start, end)).select(
        "o_orderkey", "o_custkey", as_date("o_orderdate").alias("slip_date"), dec("o_totalprice").alias("deposited"))
    j = slips.join(s, "o_orderkey").join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select("slip_date", "o_orderkey", F.col("c_name").alias("client"), F.col("deposited").cast("double").alias("deposited"),
                    F.when(F.col("deposited") != F.col("collected"), "requiere revision").otherwise("cuadrado").alias("validation"),
                    *[F.col(f"{t.lower()}_{c}").cast("double").alias(f"{t.lower()}_{c}") for t, c in SLIP_COLUMNS])


@report("fund_balances", "R34 S1 O1 J18", sql=f"""
SELECT s_suppkey, s_name, CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS balance, l_orderkey,
       CASE WHEN l_suppkey IS NULL THEN NULL
            ELSE row_number() OVER (PARTITION BY s_suppkey ORDER BY {", ".join(c for c in ['l_orderkey', *LINE_ORDER] if c != 'l_suppkey')}) END AS detail_no,
       count(l_suppkey) OVER (PARTITION BY s_suppkey) AS detail_count,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS spent
FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey AND l_returnflag = 'R'
""")
def fund_balances(spark, root):
    """Fund balances with each fund's spending lines (returns booked against the supplier
    fund), numbered per fund; funds without spending stay with a count of 0."""
    t = Tables(spark, root)
    m = t.supplier.select("s_suppkey", "s_name", dec("s_acctbal").cast("double").alias("balance"))
    d = t.lineitem.where(F.col("l_returnflag") == "R").withColumnRenamed("l_suppkey", "s_suppkey")
    order = [c for c in ["l_orderkey", *LINE_ORDER] if c != "l_suppkey"]
    md = master_detail(m, d, "s_suppkey", order)
    return md.orderBy("s_suppkey", "detail_no").select(
        "s_suppkey", "s_name", "balance", "l_orderkey", "detail_no", "detail_count",
        dec("l_extendedprice").cast("double").alias("spent"))


def _units_sql(flag: str) -> str:
    """Quantity of one flag in ten-thousandths (fractional quantities are normal)."""
    return f"CAST(SUM(CAST(l_quantity AS DECIMAL(18,4))) FILTER (WHERE l_returnflag = '{flag}') * 10000 AS HUGEINT)"


@report("order_pivots", "R37 A11 J12 J13 E29 B3 Q1", sql=f"""
WITH l AS (SELECT l_orderkey, l_returnflag, l_quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
                  CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2)) AS tax, p_type
           FROM lineitem JOIN part ON l_partkey = p_partkey),
g AS (SELECT l_orderkey,
             {", ".join(f"COALESCE(SUM(l_quantity) FILTER (WHERE l_returnflag = '{f}'), 0) AS qty_{f.lower()}" for f in "ANR")},
             {", ".join(f"COALESCE((CAST(SUM(price) FILTER (WHERE l_returnflag = '{f}') * 100 AS HUGEINT) * 20000 + {_units_sql(f)}) // NULLIF(2 * {_units_sql(f)}, 0) / 100.0, 0) AS price_{f.lower()}" for f in "ANR")},
             count(*) FILTER (WHERE p_type = 'PROMO') AS n_freight, SUM(tax) AS tax
      FROM l GROUP BY l_orderkey)
SELECT l_orderkey, qty_a, qty_n, qty_r, price_a, price_n, price_r,
       CASE WHEN n_freight > 0 THEN 'CF' ELSE 'SF' END AS freight_flag,
       CAST(ROUND(tax, 2) AS DOUBLE) AS tax, qty_a + qty_n + qty_r AS qty_total
FROM g
""")
def order_pivots(spark, root):
    """Orders with quantity and unit-price columns per product, a freight flag, the tax and
    a row sum of quantities (prices are prices here, not quantities again)."""
    t = Tables(spark, root)
    l = t.lineitem.join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    price = dec("l_extendedprice")
    flag = F.col("l_returnflag")
    g = l.groupBy("l_orderkey").agg(
        *[F.sum(F.when(flag == f, F.col("l_quantity"))).alias(f"q_{f}") for f in "ANR"],
        *[F.sum(F.when(flag == f, F.col("l_quantity").cast("decimal(18,4)"))).alias(f"u_{f}") for f in "ANR"],
        *[F.sum(F.when(flag == f, price)).alias(f"p_{f}") for f in "ANR"],
        F.count(F.when(F.col("p_type") == "PROMO", 1)).alias("n_freight"),
        F.sum(price * dec("l_tax")).alias("tax"))
    qty = {f: F.coalesce(F.col(f"q_{f}"), F.lit(0.0)) for f in "ANR"}
    for f in "ANR":   # unit price rounded half up exactly: integer division on cents and ten-thousandths
        g = g.withColumn(f"_c{f}", (F.col(f"p_{f}") * 100).cast("long")).withColumn(f"_n{f}", (F.col(f"u_{f}") * 10000).cast("long"))
        g = g.withColumn(f"price_{f.lower()}", F.coalesce(
            F.expr(f"(20000 * _c{f} + _n{f}) div nullif(2 * _n{f}, 0)") / F.lit(100.0), F.lit(0.0)))
    return g.select("l_orderkey", *[qty[f].alias(f"qty_{f.lower()}") for f in "ANR"],
                    *[F.col(f"price_{f.lower()}") for f in "ANR"],
                    F.when(F.col("n_freight") > 0, "CF").otherwise("SF").alias("freight_flag"),
                    out("tax").alias("tax"), (qty["A"] + qty["N"] + qty["R"]).alias("qty_total"))


CL_FROM, CL_TO = dt.date(1995, 1, 1), dt.date(2001, 12, 31)
CL_RATE, CL_LATE = 18.0, 5.0


@report("collection_list", "R30 E24 J1 P1 O1", sql=f"""
WITH o AS (SELECT o_custkey, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS requested FROM orders
           WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '{CL_FROM}' AND DATE '{CL_TO}' GROUP BY o_custkey)
SELECT c_custkey, c_name,
       CASE WHEN c_acctbal < 0 THEN 0.0 ELSE ROUND(c_acctbal / (CAST(requested AS DOUBLE) / 12.0 / 1000.0), 4) END AS factor,
       ROUND(CAST(requested AS DOUBLE) * {CL_RATE} / 100 * {CL_LATE} / 100, 2) AS late_fee
FROM customer JOIN o ON o_custkey = c_custkey
""")
def collection_list(spark, root, start=CL_FROM, end=CL_TO, rate=CL_RATE, late=CL_LATE):
    """Loan collection list: overdue factor (0 for a negative balance, else balance over the
    instalment) and late fee, highest factor first."""
    t = Tables(spark, root)
    o = t.orders.where(date_between("o_orderdate", start, end)).groupBy("o_custkey").agg(
        F.sum(dec("o_totalprice")).alias("requested"))
    j = t.customer.join(o, F.col("o_custkey") == F.col("c_custkey"))
    req = F.col("requested").cast("double")
    factor = F.when(F.col("c_acctbal") < 0, F.lit(0.0)).otherwise(ratio(F.col("c_acctbal"), req / 12.0 / 1000.0))
    r = j.select("c_custkey", "c_name", factor.alias("factor"),
                 F.round(req * F.lit(rate) / 100 * F.lit(late) / 100, 2).alias("late_fee"))
    return r.orderBy(F.col("factor").desc(), "c_custkey")


CH_FROM, CH_TO = dt.date(1995, 1, 1), dt.date(2001, 12, 31)
CH_BANK_ID, CH_BANK_NAME = 0, "NATION_3"


_CHEQUES_SQL = f"""{_GROUPS_SQL},
c AS (SELECT o_orderkey, c_name, o_orderdate, o_totalprice, CASE WHEN c_nationkey < 12 THEN 1 ELSE 2 END AS currency
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
      WHERE o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) BETWEEN DATE '{CH_FROM}' AND DATE '{CH_TO}'
        AND CASE WHEN {CH_BANK_ID} <> 0 THEN n_nationkey = {CH_BANK_ID} ELSE n_name = '{CH_BANK_NAME}' END)"""


def _cheques(t, start, end, bank_id, bank_name):
    n = t.nation.where(one_of("n_nationkey", bank_id, "n_name", bank_name)).select("n_nationkey")
    c = (t.orders.where((F.col("o_orderstatus") == "F") & date_between("o_orderdate", start, end))
                 .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
                 .join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
                 .select("o_orderkey", F.col("c_name").alias("payee"), "o_orderdate", "o_totalprice",
                         F.when(F.col("c_nationkey") < 12, 1).otherwise(2).alias("currency")))
    return c


@report("cheque_register", "R28 R31 E13 E26 F1 P4 J1 J2 B16 E36 Q3", sql=f"""
WITH {_CHEQUES_SQL},
a AS (SELECT l_orderkey, SUM(CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS debit,
             SUM(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS credit
      FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, c_name AS payee, currency, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount,
       CAST(COALESCE(debit, 0) AS DOUBLE) AS debit, CAST(COALESCE(credit, 0) AS DOUBLE) AS credit,
       lpad(CAST(day(o_orderdate) AS VARCHAR), 2, '0') || ' de ' || {_MES}[month(o_orderdate)] || ' del ' || CAST(year(o_orderdate) AS VARCHAR) AS long_date,
       {_words_sql('o_totalprice', 'currency')} AS amount_words
FROM c LEFT JOIN a ON o_orderkey = l_orderkey
""")
def cheque_register(spark, root, start=CH_FROM, end=CH_TO, bank_id=CH_BANK_ID, bank_name=CH_BANK_NAME):
    """Cheques of a period drawn on one bank (chosen by id when given, else by name): payee,
    date and amount in words (all parts from the payment date), and the accounting lines'
    debit and credit per cheque. Only the chosen cheques' lines are aggregated."""
    t = Tables(spark, root)
    c = _cheques(t, start, end, bank_id, bank_name)
    amt = dec("l_extendedprice")
    own = t.lineitem.join(c.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    a = own.groupBy("l_orderkey").agg(
        F.sum(F.when(F.col("l_returnflag") != "R", amt).otherwise(F.lit(0))).alias("debit"),
        F.sum(F.when(F.col("l_returnflag") == "R", amt).otherwise(F.lit(0))).alias("credit"))
    j = c.join(a, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select("o_orderkey", "payee", "currency", dec("o_totalprice").cast("double").alias("amount"),
                    F.coalesce("debit", F.lit(0)).cast("double").alias("debit"),
                    F.coalesce("credit", F.lit(0)).cast("double").alias("credit"),
                    long_date_es("o_orderdate").alias("long_date"),
                    amount_in_words(F.col("o_totalprice"), F.col("currency")).alias("amount_words"))


@report("cheque_lines", "R28 R31 B16 J1 J2 E26 F1 P4", sql=f"""
WITH {_CHEQUES_SQL}
SELECT o_orderkey, c_name AS payee, l_linenumber, l_partkey,
       CAST(CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END AS DOUBLE) AS debit,
       CAST(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END AS DOUBLE) AS credit,
       {_words_sql('o_totalprice', 'currency')} AS amount_words
FROM c LEFT JOIN lineitem ON o_orderkey = l_orderkey
""")
def cheque_lines(spark, root, start=CH_FROM, end=CH_TO, bank_id=CH_BANK_ID, bank_name=CH_BANK_NAME):
    """The cheques of ``cheque_register`` with their accounting lines, by cheque and line; a
    cheque without lines stays, with zeros."""
    t = Tables(spark, root)
    c = _cheques(t, start, end, bank_id, bank_name)
    amt, zero, credit = dec("l_extendedprice"), F.lit(0), F.col("l_returnflag") == "R"
    j = c.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    r = j.select("o_orderkey", "payee", "l_linenumber", "l_partkey",
                 F.when(~credit, amt).otherwise(zero).cast("double").alias("debit"),
                 F.when(credit, amt).otherwise(zero).cast("double").alias("credit"),
                 amount_in_words(F.col("o_totalprice"), F.col("currency")).alias("amount_words"))
    return r.orderBy("o_orderkey", "l_linenumber", "l_partkey", "debit", "credit")


POS_STATIONS = ("1-URGENT", "2-HIGH")
POS_FROM, POS_TO = dt.date(1995, 1, 1), dt.date(2001, 12, 31)


@report("pos_close", "R29 J20 J5 P1 P2 E1 Q9", sql=f"""
WITH s AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS station FROM orders
           WHERE o_orderpriority IN {POS_STATIONS} AND CAST(o_orderdate AS DATE) BETWEEN DATE '{POS_FROM}' AND DATE '{POS_TO}'),
inv AS (SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'N'),
ord AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag <> 'N'),
fan AS (SELECT day, station, count(*) AS n_pairs, SUM(inv.l_quantity) AS repeated_qty
        FROM s JOIN inv ON inv.l_orderkey = o_orderkey JOIN ord ON ord.l_orderkey = o_orderkey GROUP BY day, station),
ded AS (SELECT day, station, SUM(inv.l_quantity) AS matched_qty
        FROM s JOIN inv ON inv.l_orderkey = o_orderkey JOIN ord ON ord.l_orderkey = o_orderkey AND ord.l_partkey = inv.l_partkey
        GROUP BY day, station),
inv_q AS (SELECT day, station, SUM(l_quantity) AS invoiced_qty FROM s JOIN inv ON l_orderkey = o_orderkey GROUP BY day, station)
SELECT inv_q.day, inv_q.station, invoiced_qty, COALESCE(n_pairs, 0) AS n_pairs, COALESCE(repeated_qty, 0) AS repeated_qty,
       COALESCE(matched_qty, 0) AS matched_qty
FROM inv_q LEFT JOIN fan ON inv_q.day = fan.day AND inv_q.station = fan.station
LEFT JOIN ded ON inv_q.day = ded.day AND inv_q.station = ded.station
""")
def pos_close(spark, root, stations=POS_STATIONS, start=POS_FROM, end=POS_TO):
    """Point-of-sale close per day and station: invoiced quantity, and the totals the
    report's join of invoice lines x order lines (by document only) produces, next to the
    de-duplicated join on document and product. Pairs are counted, never built."""
    t = Tables(spark, root)
    s = t.orders.where(in_list("o_orderpriority", stations) & date_between("o_orderdate", start, end)).select(
        "o_orderkey", as_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("station"))
    li = t.lineitem.join(s, F.col("l_orderkey") == F.col("o_orderkey"))
    inv = li.where(F.col("l_returnflag") == "N")
    ordl = li.where(F.col("l_returnflag") != "N")
    inv_doc = inv.groupBy("day", "station", "l_orderkey").agg(F.count(F.lit(1)).alias("na"), F.sum("l_quantity").alias("qa"))
    ord_doc = ordl.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("nb"))
    fan = (inv_doc.join(ord_doc, "l_orderkey", "left")
                  .groupBy("day", "station").agg(F.sum("qa").alias("invoiced_qty"),
                                                 F.sum(F.col("na") * F.coalesce("nb", F.lit(0))).alias("n_pairs"),
                                                 F.sum(F.col("qa") * F.coalesce("nb", F.lit(0))).alias("repeated_qty")))
    inv_pp = inv.groupBy("day", "station", "l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("qa"))
    ord_pp = ordl.groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("nb"))
    ded = (inv_pp.join(ord_pp, ["l_orderkey", "l_partkey"])
                 .groupBy("day", "station").agg(F.sum(F.col("qa") * F.col("nb")).alias("matched_qty")))
    j = fan.join(ded, ["day", "station"], "left")
    return j.select("day", "station", "invoiced_qty", F.col("n_pairs").cast("long").alias("n_pairs"),
                    F.coalesce("repeated_qty", F.lit(0.0)).alias("repeated_qty"),
                    F.coalesce("matched_qty", F.lit(0.0)).alias("matched_qty"))


SW_FROM, SW_TO = dt.date(1995, 1, 1), dt.date(2001, 12, 31)


def _slip_detail_sql() -> str:
    from ledgerflow.plans.registry import REGISTRY
    return REGISTRY["union_branches"].sql


@report("slips_with_detail", "R26 J18 O6 P1", sql="""
WITH u AS ({union}),
m AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS slip_date FROM orders
      WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '{start}' AND DATE '{end}')
SELECT m.o_orderkey, slip_date, source, doc, amount,
       CASE WHEN u.o_orderkey IS NULL THEN NULL
            ELSE row_number() OVER (PARTITION BY m.o_orderkey ORDER BY source, doc) END AS detail_no,
       count(u.o_orderkey) OVER (PARTITION BY m.o_orderkey) AS detail_count
FROM m LEFT JOIN u ON m.o_orderkey = u.o_orderkey
""".format(union=_slip_detail_sql(), start=SW_FROM, end=SW_TO))
def slips_with_detail(spark, root, start=SW_FROM, end=SW_TO):
    """Deposit slips of a period, each with its detail lines from the three stacked
    sources (one join instead of one sub-report per slip), numbered per slip."""
    t = Tables(spark, root)
    m = t.orders.where(date_between("o_orderdate", start, end)).select(
        "o_orderkey", as_date("o_orderdate").alias("slip_date"))
    u = union_branches(spark, root).select("o_orderkey", "source", "doc", "amount")
    md = master_detail(m, u, "o_orderkey", ["source", "doc"])
    return md.select("o_orderkey", "slip_date", "source", "doc", "amount", "detail_no", "detail_count")


PV_FROM, PV_TO = dt.date(1995, 1, 1), dt.date(2001, 12, 31)
PV_NATION_ID, PV_NATION_NAME = 0, "NATION_11"


@report("payment_vouchers", "R10 J7 J1 P4 E15 B16", sql=f"""
WITH pay AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'
             AND CAST(o_orderdate AS DATE) BETWEEN DATE '{PV_FROM}' AND DATE '{PV_TO}'),
bridge AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
inv AS (SELECT l_orderkey, l_suppkey, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS invoice_amount
        FROM lineitem GROUP BY 1, 2),
sup AS (SELECT s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
        WHERE CASE WHEN {PV_NATION_ID} <> 0 THEN n_nationkey = {PV_NATION_ID} ELSE n_name = '{PV_NATION_NAME}' END),
v AS (SELECT pay.o_orderkey, s_name || ' / ' || CAST(b.l_suppkey AS VARCHAR) AS supplier, invoice_amount
      FROM pay JOIN bridge b ON b.l_orderkey = pay.o_orderkey JOIN sup ON b.l_suppkey = s_suppkey
      JOIN inv ON inv.l_orderkey = b.l_orderkey AND inv.l_suppkey = b.l_suppkey)
SELECT o_orderkey, supplier, CAST(invoice_amount AS DOUBLE) AS invoice_amount,
       CAST(SUM(invoice_amount) OVER (PARTITION BY o_orderkey) AS DOUBLE) AS voucher_total
FROM v
""")
def payment_vouchers(spark, root, start=PV_FROM, end=PV_TO, nation_id=PV_NATION_ID, nation_name=PV_NATION_NAME):
    """Payment vouchers of a period with the supplier invoices they settle, linked through a
    payment-invoice bridge; suppliers of one country (by id when given, else by name);
    each voucher's total on its rows. The bridge is the key set of the invoice sums, and
    only lines of the chosen vouchers and suppliers are summed."""
    t = Tables(spark, root)
    pay = t.orders.where((F.col("o_orderstatus") == "F") & date_between("o_orderdate", start, end)).select("o_orderkey")
    nat = t.nation.where(one_of("n_nationkey", nation_id, "n_name", nation_name)).select("n_nationkey")
    sup = (t.supplier.join(nat, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
                     .select("s_suppkey", "s_name"))
    inv = (t.lineitem.join(sup.select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
                     .join(pay, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
                     .groupBy("l_orderkey", "l_suppkey").agg(F.sum(dec("l_extendedprice")).alias("invoice_amount")))
    v = inv.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).withColumnRenamed("l_orderkey", "o_orderkey")
    total = F.sum("invoice_amount").over(Window.partitionBy("o_orderkey"))      # at most one row a supplier
    return v.withColumn("voucher_total", total).select(
        "o_orderkey", F.concat("s_name", F.lit(" / "), F.col("l_suppkey").cast("string")).alias("supplier"),
        F.col("invoice_amount").cast("double").alias("invoice_amount"),
        F.col("voucher_total").cast("double").alias("voucher_total"))


SV_NUMBER, SV_NAME = 0, "PAGO/1997"


@report("settlement_vouchers", "R10 J1 J2 J6 P4 E15 O1", sql=f"""
WITH pay AS (SELECT o_orderkey AS check_number, o_custkey, o_orderdate, o_totalprice,
                    'PAGO/' || CAST(year(o_orderdate) AS VARCHAR) AS name,
                    'LIQ-' || CAST(year(o_orderdate) * 100 + month(o_orderdate) AS VARCHAR) || '/' || o_orderpriority AS settlement
             FROM orders WHERE o_orderstatus = 'F')
SELECT check_number, CAST(o_orderdate AS DATE) AS payment_date, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount,
       r_name AS company, n_name AS company_ref, c_name AS provider, name, settlement,
       CAST(o_orderdate AS DATE) AS invoice_date, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS invoice_total
FROM pay JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE settlement IS NOT NULL AND CASE WHEN {SV_NUMBER} <> 0 THEN check_number = {SV_NUMBER} ELSE name = '{SV_NAME}' END
ORDER BY check_number
""")
def settlement_vouchers(spark, root, number=SV_NUMBER, name=SV_NAME):
    """Vouchers of payments that close a settlement, by cheque number when it is given and
    non-zero, else by the payment's name: company with its reference, provider, cheque and the
    settlement in place of the invoice, whose date and total are the payment's own. In cheque
    order. Payments without a settlement (here: without a journal) do not appear."""
    t = Tables(spark, root)
    period = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("string")
    pay = t.orders.where((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isNotNull()).select(
        F.col("o_orderkey").alias("check_number"), "o_custkey", as_date("o_orderdate").alias("payment_date"),
        dec("o_totalprice").cast("double").alias("amount"),
        F.concat(F.lit("PAGO/"), F.year("o_orderdate").cast("string")).alias("name"),
        F.concat(F.lit("LIQ-"), period, F.lit("/"), "o_orderpriority").alias("settlement"))
    pay = pay.where(one_of("check_number", number, "name", name))
    j = (pay.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(t.region, F.col("n_regionkey") == F.col("r_regionkey")))
    return j.select("check_number", "payment_date", "amount", F.col("r_name").alias("company"), F.col("n_name").alias("company_ref"),
                    F.col("c_name").alias("provider"), "name", "settlement", F.col("payment_date").alias("invoice_date"),
                    F.col("amount").alias("invoice_total")).orderBy("check_number")
