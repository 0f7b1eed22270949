"""Pivot and crosstab reports: wide pivots (sum, last value, by date, joined, merged
categories), crosstab with subtotals, ageing, weighted prices, metric stacks, profit,
budget and reconciliation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerflow.functions.dates import as_date, business_day, days_between
from ledgerflow.functions.money import dec, out, ratio
from ledgerflow.functions.text import key_after, split_docnum
from ledgerflow.functions.predicates import in_list
from ledgerflow.operators.aging import AGE_BUCKETS, bucket_columns
from ledgerflow.operators.nest import reconcile
from ledgerflow.operators.pivot import cell, crosstab_totals, query_pivot, wide_pivot
from ledgerflow.operators.totals import cross_scalar, stack_metrics, with_total_row
from ledgerflow.plans.columns import _DOCNUM_SQL, SQL_MARK, docnum
from ledgerflow.plans.common import SQL_LINE_AMOUNT, STATUS_LABELS, decode, line_amount, sql_decode
from ledgerflow.plans.registry import report
from ledgerflow.sources import Tables, values

FLAGS = [("A", "qty_a"), (("A", "N"), "qty_an"), ("N", "qty_n"), ("R", "qty_r")]


@report("wide_pivot_sum", "A11 A12 F2 R44", sql="""
SELECT l_orderkey,
       COALESCE(SUM(l_quantity) FILTER (WHERE l_returnflag = 'A'), 0) AS qty_a,
       COALESCE(SUM(l_quantity) FILTER (WHERE l_returnflag IN ('A', 'N')), 0) AS qty_an,
       COALESCE(SUM(l_quantity) FILTER (WHERE l_returnflag = 'N'), 0) AS qty_n,
       COALESCE(SUM(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0) AS qty_r
FROM lineitem GROUP BY l_orderkey
""")
def wide_pivot_sum(spark, root):
    """Quantity per document with one column per declared category; ``qty_an`` merges two
    source labels into one column; missing cells are 0."""
    return wide_pivot(Tables(spark, root).lineitem, ["l_orderkey"], "l_returnflag", FLAGS, "l_quantity")


# The product classes of the test tables, as the category query finds them.
CLASS_COLUMNS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@report("crosstab_query", "F2 A11 J2 J16 R37", sql=f"""
SELECT o_orderkey, {", ".join(f"COALESCE(SUM(l_quantity) FILTER (WHERE p_type = '{c}'), 0) AS cant_{c.lower()}" for c in CLASS_COLUMNS)}
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN part ON l_partkey = p_partkey
GROUP BY o_orderkey
""")
def crosstab_query(spark, root):
    """Orders with one quantity column per product class, the classes read from the product table
    in their own order (the crosstab's category query); orders without lines stay with zeros."""
    t = Tables(spark, root)
    li = t.lineitem.join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"), "left")
    cells = query_pivot(li, ["l_orderkey"], "p_type", F.col("l_quantity"), t.part.select("p_type"),
                        name=lambda v: f"cant_{v.lower()}")
    j = t.orders.select("o_orderkey").join(cells, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select("o_orderkey", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in cells.columns[1:]])


TIE_BREAK = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
             "l_tax", "l_returnflag", "l_shipdate"]


@report("wide_pivot_last", "A15 A19 Q2 Q14", sql=f"""
WITH r AS (
  SELECT l_orderkey, l_linestatus,
         l_returnflag || ':' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS v,
         row_number() OVER (PARTITION BY l_orderkey, l_linestatus
                            ORDER BY {", ".join(c + " DESC" for c in TIE_BREAK)}) AS rn
  FROM lineitem)
SELECT l_orderkey,
       max(v) FILTER (WHERE l_linestatus = 'O' AND rn = 1) AS last_open,
       max(v) FILTER (WHERE l_linestatus = 'F' AND rn = 1) AS last_done
FROM r GROUP BY l_orderkey
""")
def wide_pivot_last(spark, root):
    """Text-valued pivot keeping the last row of each cell under a full tie-break (the value
    a row-by-row crosstab shows); computed with ``max_by`` inside one aggregation."""
    li = Tables(spark, root).lineitem
    v = F.concat("l_returnflag", F.lit(":"), dec("l_extendedprice").cast("string"))
    return wide_pivot(li, ["l_orderkey"], "l_linestatus", [("O", "last_open"), ("F", "last_done")], v,
                      agg="last", order=TIE_BREAK, fill=None)


@report("pivot_by_date", "A14 A11 R18", sql="""
SELECT CAST(o_orderdate AS DATE) AS day,
       {cols}
FROM orders GROUP BY 1
""".format(cols=",\n       ".join(
    f"CAST(ROUND(COALESCE(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = '{s}'), 0), 2) AS DOUBLE) AS amt_{s.lower()}"
    for s in "FOP")))
def pivot_by_date(spark, root):
    """Daily amounts with one column per state (pivot keyed by date)."""
    o = Tables(spark, root).orders
    p = wide_pivot(o, [as_date("o_orderdate").alias("day")], "o_orderstatus",
                   [(s, f"amt_{s.lower()}") for s in "FOP"], dec("o_totalprice"))
    return p.select("day", *[out(f"amt_{s.lower()}").alias(f"amt_{s.lower()}") for s in "FOP"])


# Tax kind by line tax rate (rates of 5% and above are VAT).
VAT_FROM = 0.05


@report("pivots_joined", "J16 J19 A11 J2 E4 R35 R33", sql=f"""
WITH q AS (
  SELECT l_orderkey,
         SUM(l_quantity) FILTER (WHERE l_returnflag = 'A') AS qty_a,
         SUM(l_quantity) FILTER (WHERE l_returnflag = 'N') AS qty_n,
         SUM(l_quantity) FILTER (WHERE l_returnflag = 'R') AS qty_r,
         SUM({SQL_LINE_AMOUNT}) FILTER (WHERE l_linestatus = 'O') AS amt_o,
         SUM({SQL_LINE_AMOUNT}) FILTER (WHERE l_linestatus = 'F') AS amt_f
  FROM lineitem GROUP BY l_orderkey),
tx AS (
  SELECT l_orderkey, CASE WHEN l_tax >= {VAT_FROM} THEN 'vat' ELSE 'fuel' END AS kind,
         CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2)) AS tax FROM lineitem),
t AS (
  SELECT l_orderkey, SUM(tax) FILTER (WHERE kind = 'vat') AS tax_vat, SUM(tax) FILTER (WHERE kind = 'fuel') AS tax_fuel
  FROM tx GROUP BY l_orderkey),
d AS (SELECT DISTINCT o_orderkey, o_custkey FROM orders)
SELECT d.o_orderkey, d.o_custkey,
       COALESCE(qty_a, 0) AS qty_a, COALESCE(qty_n, 0) AS qty_n, COALESCE(qty_r, 0) AS qty_r,
       CAST(ROUND(COALESCE(amt_o, 0), 2) AS DOUBLE) AS amt_o, CAST(ROUND(COALESCE(amt_f, 0), 2) AS DOUBLE) AS amt_f,
       CAST(ROUND(COALESCE(tax_vat, 0), 2) AS DOUBLE) AS tax_vat, CAST(ROUND(COALESCE(tax_fuel, 0), 2) AS DOUBLE) AS tax_fuel
FROM d LEFT JOIN q ON d.o_orderkey = q.l_orderkey LEFT JOIN t ON d.o_orderkey = t.l_orderkey
""")
def pivots_joined(spark, root):
    """Per document: quantity, amount and tax pivots in one pass over the lines, left-joined
    to the distinct documents; missing cells 0."""
    t = Tables(spark, root)
    kind = F.when(F.col("l_tax") >= VAT_FROM, "vat").otherwise("fuel")
    qa = t.lineitem.groupBy("l_orderkey").agg(
        *[F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))).alias(f"qty_{f.lower()}") for f in "ANR"],
        *[F.sum(F.when(F.col("l_linestatus") == s, line_amount())).alias(f"amt_{s.lower()}") for s in "OF"],
        *[cell(kind, k, dec("l_extendedprice") * dec("l_tax")).alias(f"tax_{k}") for k in ("vat", "fuel")])
    d = t.orders.select("o_orderkey", "o_custkey").distinct()
    j = d.join(qa, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select("o_orderkey", "o_custkey", *[z(f"qty_{f}").alias(f"qty_{f}") for f in "anr"],
                    *[out(z(c)).alias(c) for c in ("amt_o", "amt_f", "tax_vat", "tax_fuel")])


# Product class of each account group; unlisted groups are "otros".
PRODUCT_CLASS = [("ECONOMY", "regular"), ("STANDARD", "regular"), ("LARGE", "diesel"), ("PROMO", "super")]
CLASSES = ["regular", "diesel", "super", "otros"]


@report("merged_products", "A13 J2 S2 E1 R33", sql=f"""
WITH m(ptype, cls) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in PRODUCT_CLASS)}),
l AS (SELECT l_orderkey, COALESCE(cls, 'otros') AS cls, l_quantity
      FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN m ON p_type = m.ptype)
SELECT l_orderkey, {", ".join(f"COALESCE(SUM(l_quantity) FILTER (WHERE cls = '{c}'), 0) AS qty_{c}" for c in CLASSES)}
FROM l GROUP BY l_orderkey
""")
def merged_products(spark, root):
    """Product columns after mapping sub-products to classes through a mapping relation
    (several groups summed into one column, the rest into "otros")."""
    t = Tables(spark, root)
    m = values(spark, PRODUCT_CLASS, "ptype string, cls string")
    l = (t.lineitem.join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
                   .join(m, F.col("p_type") == F.col("ptype"), "left")
                   .withColumn("cls", F.coalesce("cls", F.lit("otros"))))
    return wide_pivot(l, ["l_orderkey"], "cls", [(c, f"qty_{c}") for c in CLASSES], "l_quantity")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
# Custom display order of the states.
STATUS_RANK = {"P": 1, "O": 2, "F": 3}


@report("crosstab_sum", "A18 F3 O3", sql="""
SELECT o_orderstatus,
       CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 WHEN 'F' THEN 3 END AS status_rank,
       {cols},
       count(*) FILTER (WHERE o_orderstatus = 'F' OR upper(o_orderpriority) = '1-URGENT') AS n_paid_or_urgent
FROM orders GROUP BY o_orderstatus
""".format(cols=",\n       ".join(
    f"CAST(ROUND(COALESCE(SUM(abs(CAST(o_totalprice AS DECIMAL(18,2)))) FILTER (WHERE o_orderpriority = '{p}'), 0), 2) AS DOUBLE) AS p{p[0]}"
    for p in PRIORITIES)))
def crosstab_sum(spark, root):
    """States x journal kinds crosstab (sum, no totals), with a custom sort rank and a count
    built from row helpers (or, equals, upper, abs)."""
    o = Tables(spark, root).orders
    rank = None
    for k, v in STATUS_RANK.items():
        rank = F.when(F.col("o_orderstatus") == k, v) if rank is None else rank.when(F.col("o_orderstatus") == k, v)
    flag = (F.col("o_orderstatus") == "F") | (F.upper("o_orderpriority") == "1-URGENT")
    p = wide_pivot(o, ["o_orderstatus"], "o_orderpriority", [(p, f"p{p[0]}") for p in PRIORITIES],
                   F.abs(dec("o_totalprice")), extra=[F.count(F.when(flag, 1)).alias("n_paid_or_urgent")])
    return p.select("o_orderstatus", rank.alias("status_rank"), *[out(f"p{p[0]}").alias(f"p{p[0]}") for p in PRIORITIES],
                    "n_paid_or_urgent")


SHIFT_HOURS = -6


@report("net_units_crosstab", "A17 E21 E22 A3 R32", sql=f"""
WITH m AS (
  SELECT l_linestatus, year(CAST(o_orderdate - INTERVAL 6 HOUR AS DATE)) AS yr, c_mktsegment, l_returnflag,
         CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS units
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
SELECT l_linestatus, yr, c_mktsegment, l_returnflag,
       GROUPING(l_linestatus, yr, c_mktsegment, l_returnflag) AS gid, SUM(units) AS units
FROM m GROUP BY ROLLUP (l_linestatus, yr), ROLLUP (c_mktsegment, l_returnflag)
""")
def net_units_crosstab(spark, root, shift_hours=SHIFT_HOURS):
    """Net units (returns negative) by (line state, business year) x (segment, movement)
    with row subtotals, column subtotals and the grand total; the business day is the
    timestamp shifted by ``shift_hours``. The lines are summed to the four keys first; only
    those sums are rolled up."""
    t = Tables(spark, root)
    m = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
                   .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
                   .select("l_linestatus", F.year(business_day("o_orderdate", shift_hours)).alias("yr"),
                           "c_mktsegment", "l_returnflag",
                           F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("units")))
    rows, cols = ["l_linestatus", "yr"], ["c_mktsegment", "l_returnflag"]
    leaf = m.groupBy(*rows, *cols).agg(F.sum("units").alias("units"))
    r = crosstab_totals(leaf, rows, cols, [F.sum("units").alias("units")])
    return r.select("l_linestatus", "yr", "c_mktsegment", "l_returnflag", F.col("gid").cast("long").alias("gid"), "units")


AGE_AS_OF = dt.date(2001, 6, 30)


def _age_sql() -> str:
    cols = []
    for name, lo, hi in AGE_BUCKETS:
        cond = f"age >= {lo}" if hi is None else f"age BETWEEN {lo} AND {hi}"
        cols.append(f"CASE WHEN {cond} THEN amt ELSE 0 END AS {name}")
    sums = ", ".join(f"SUM({n})" for n, _, _ in AGE_BUCKETS)
    outs = ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n, _, _ in AGE_BUCKETS)
    return f"""
WITH r AS (
  SELECT o_orderkey, datediff('day', CAST(o_orderdate AS DATE), DATE '{AGE_AS_OF}') AS age,
         CAST(o_totalprice AS DECIMAL(18,2)) AS amt
  FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 0),
b AS (SELECT o_orderkey, age, amt, {", ".join(cols)} FROM r WHERE age >= 0),
u AS (SELECT CAST(o_orderkey AS VARCHAR) AS doc, age, amt, {", ".join(n for n, _, _ in AGE_BUCKETS)}, CAST(NULL AS BIGINT) AS n_docs FROM b
      UNION ALL
      SELECT 'Total', NULL, SUM(amt), {sums}, count(*) FROM b)
SELECT doc, age AS age_days, CAST(amt AS DOUBLE) AS balance, {outs}, n_docs FROM u"""


@report("age_buckets", "A16 B3 B4 P13 E8 E36 R38 Q16", sql=_age_sql())
def age_buckets(spark, root, as_of=AGE_AS_OF):
    """Open documents aged at ``as_of`` with the residual in its day bucket, plus a total row
    (bucket totals, balance total and document count)."""
    o = Tables(spark, root).orders.where((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 0)
                                         & (as_date("o_orderdate") <= F.lit(as_of)))   # age >= 0, pushable
    r = o.select(F.col("o_orderkey").cast("string").alias("doc"), days_between(F.lit(as_of), "o_orderdate").alias("age_days"),
                 dec("o_totalprice").alias("balance")).where(F.col("age_days") >= 0)
    b = r.select("doc", "age_days", "balance", *bucket_columns(F.col("age_days"), F.col("balance")))
    names = [n for n, _, _ in AGE_BUCKETS]
    tot = b.agg(F.sum("balance").alias("balance"), *[F.sum(n).alias(n) for n in names],
                F.count(F.lit(1)).alias("n_docs"))
    rows = b.withColumn("n_docs", F.lit(None).cast("long"))
    res = with_total_row(rows, "doc", "Total", tot)
    return res.select("doc", F.col("age_days").cast("long").alias("age_days"),
                      *[F.col(c).cast("double").alias(c) for c in ["balance", *names]], "n_docs")


SUBSIDY = "0.50"
GALLONS_PER_BARREL = 42


def _weighted_parts():
    sub = "CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))"
    tax = "CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2))"
    return sub, tax


@report("weighted_price", "A9 E20 J1", sql=f"""
SELECT p_type, SUM(l_quantity) AS gallons, ROUND(SUM(l_quantity) / {GALLONS_PER_BARREL}, 4) AS barrels,
       ROUND(CAST(SUM({_weighted_parts()[0]} * 1.12 + {_weighted_parts()[1]} + CAST(l_quantity AS DECIMAL(18,2)) * {SUBSIDY}) AS DOUBLE)
             / SUM(l_quantity), 5) AS price_with_tax
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type
""")
def weighted_price(spark, root, subsidy=SUBSIDY):
    """Volume in gallons and barrels and the average price with tax and subsidy,
    sum(subtotal x 1.12 + tax + qty x subsidy) / sum(qty), per product group."""
    t = Tables(spark, root)
    j = t.lineitem.join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    num = (line_amount() * F.lit("1.12").cast("decimal(4,2)") + dec("l_extendedprice") * dec("l_tax")
           + dec("l_quantity") * F.lit(subsidy).cast("decimal(6,2)"))
    g = j.groupBy("p_type").agg(F.sum("l_quantity").alias("gallons"), F.sum(num).alias("num"))
    return g.select("p_type", "gallons", F.round(F.col("gallons") / GALLONS_PER_BARREL, 4).alias("barrels"),
                    ratio("num", "gallons", 5).alias("price_with_tax"))


STACK_DAY = dt.date(1998, 8, 2)
EXCHANGE = 7.8


def _two_days(lines, day):
    """Lines of ``day`` and the next (as a pushable range), and whether a line is of ``day``."""
    d = as_date("l_shipdate")
    span = (F.col("l_shipdate") >= F.lit(day)) & (F.col("l_shipdate") < F.lit(day + dt.timedelta(days=2)))
    return lines.where(span), d == F.lit(day)


@report("metric_stack", "O8 E31 E20 A9 R42 Q23", sql=f"""
WITH g AS (
  SELECT p_type, COALESCE(SUM(l_quantity) FILTER (WHERE today), 0) AS gallons,
         CAST(SUM({_weighted_parts()[0]}) FILTER (WHERE today) AS DOUBLE) AS subtotal,
         CAST(SUM({_weighted_parts()[0]} * 1.12 + {_weighted_parts()[1]}) FILTER (WHERE today) AS DOUBLE) AS with_tax,
         SUM(l_quantity) FILTER (WHERE NOT today) AS next_day
  FROM (SELECT *, CAST(l_shipdate AS DATE) = DATE '{STACK_DAY}' AS today FROM lineitem
        WHERE CAST(l_shipdate AS DATE) IN (DATE '{STACK_DAY}', DATE '{STACK_DAY}' + INTERVAL 1 DAY))
  JOIN part ON l_partkey = p_partkey GROUP BY p_type),
s AS (
  SELECT p_type, 'gallons' AS metric, gallons AS value FROM g
  UNION ALL SELECT p_type, 'barrels', ROUND(gallons / {GALLONS_PER_BARREL}, 4) FROM g
  UNION ALL SELECT p_type, 'price_with_tax', ROUND(with_tax / NULLIF(gallons, 0) + {SUBSIDY}, 5) FROM g
  UNION ALL SELECT p_type, 'price_usd_cents', ROUND((subtotal / NULLIF(gallons, 0) + {SUBSIDY} / 1.12) / {EXCHANGE} * 100, 5) FROM g
  UNION ALL SELECT p_type, 'next_day_gallons', COALESCE(next_day, 0) FROM g
  UNION ALL SELECT p_type, 'next_day_barrels', ROUND(COALESCE(next_day, 0) / {GALLONS_PER_BARREL}, 4) FROM g)
SELECT p_type, metric, value, 'Ventas al ' || strftime(DATE '{STACK_DAY}', '%d/%m/%Y') AS label FROM s
""")
def metric_stack(spark, root, day=STACK_DAY, exchange=EXCHANGE, subsidy=SUBSIDY):
    """Six metric rows of one day per product group (those sold on the day or the next),
    computed in one aggregation and stacked (instead of six UNION ALL branches each scanning
    the lines). Prices include the subsidy per gallon; without sales they are NULL."""
    t = Tables(spark, root)
    lines, today = _two_days(t.lineitem, day)
    j = lines.join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    with_tax = line_amount() * F.lit("1.12").cast("decimal(4,2)") + dec("l_extendedprice") * dec("l_tax")
    g = j.groupBy("p_type").agg(
        F.coalesce(F.sum(F.when(today, F.col("l_quantity"))), F.lit(0.0)).alias("gallons"),
        F.sum(F.when(today, line_amount())).cast("double").alias("subtotal"),
        F.sum(F.when(today, with_tax)).cast("double").alias("with_tax"),
        F.sum(F.when(~today, F.col("l_quantity"))).alias("next_day"))
    nd = F.coalesce(F.col("next_day"), F.lit(0.0))
    per = F.lit(float(subsidy))
    s = stack_metrics(g, ["p_type"], [
        ("gallons", F.col("gallons")),
        ("barrels", F.round(F.col("gallons") / GALLONS_PER_BARREL, 4)),
        ("price_with_tax", F.round(ratio("with_tax", "gallons", None) + per, 5)),
        ("price_usd_cents", F.round((ratio("subtotal", "gallons", None) + per / 1.12) / F.lit(exchange) * 100, 5)),
        ("next_day_gallons", nd),
        ("next_day_barrels", F.round(nd / GALLONS_PER_BARREL, 4)),
    ])
    return s.withColumn("label", F.concat(F.lit("Ventas al "), F.date_format(F.lit(day), "dd/MM/yyyy")))


COST_FACTOR = "0.60"
PROPERTY_PREFIX = "product.product,"


def property_table(t: Tables):
    """Typed key/value properties derived from the product table: the key is embedded in a
    text id (``product.product,<n>``), the value is typed by the property name."""
    p = t.part
    rid = F.concat(F.lit(PROPERTY_PREFIX), F.col("p_partkey").cast("string"))
    cost = p.select(rid.alias("res_id"), F.lit("standard_price").alias("name"),
                    F.round(dec("p_retailprice") * F.lit(COST_FACTOR).cast("decimal(4,2)"), 2).alias("value_float"))
    price = p.select(rid.alias("res_id"), F.lit("list_price").alias("name"), dec("p_retailprice").alias("value_float"))
    return cost.unionByName(price)


@report("product_profit", "A22 S4 J17 E25 J8 O9 R41 Q22", sql=f"""
WITH prop AS (
  SELECT '{PROPERTY_PREFIX}' || CAST(p_partkey AS VARCHAR) AS res_id, 'standard_price' AS name,
         ROUND(CAST(p_retailprice AS DECIMAL(18,2)) * {COST_FACTOR}, 2) AS value_float FROM part
  UNION ALL
  SELECT '{PROPERTY_PREFIX}' || CAST(p_partkey AS VARCHAR), 'list_price', CAST(p_retailprice AS DECIMAL(18,2)) FROM part),
g AS (
  SELECT l_partkey, SUM(l_quantity) AS qty, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS revenue,
         SUM(CAST(l_quantity AS DECIMAL(18,2)) * value_float) AS cost
  FROM lineitem JOIN prop ON TRY_CAST(substr(res_id, {len(PROPERTY_PREFIX) + 1}) AS BIGINT) = l_partkey AND name = 'standard_price'
  GROUP BY l_partkey),
u AS (SELECT CAST(l_partkey AS VARCHAR) AS product, qty, revenue, cost FROM g
      UNION ALL SELECT 'Total', SUM(qty), SUM(revenue), SUM(cost) FROM g)
SELECT product, qty, CAST(revenue AS DOUBLE) AS revenue, CAST(cost AS DOUBLE) AS cost,
       CAST(revenue - cost AS DOUBLE) AS profit FROM u
""")
def product_profit(spark, root):
    """Profit per product = quantity x price - quantity x cost, the cost read from a typed
    property relation keyed by text, plus a grand-total row."""
    t = Tables(spark, root)
    prop = property_table(t)
    cond = (key_after("res_id", len(PROPERTY_PREFIX) + 1) == F.col("l_partkey")) & (F.col("name") == "standard_price")
    j = t.lineitem.join(prop, cond)
    g = j.groupBy(F.col("l_partkey").cast("string").alias("product")).agg(
        F.sum("l_quantity").alias("qty"), F.sum(dec("l_extendedprice")).alias("revenue"),
        F.sum(dec("l_quantity") * F.col("value_float")).alias("cost"))
    tot = g.agg(F.sum("qty").alias("qty"), F.sum("revenue").alias("revenue"), F.sum("cost").alias("cost"))
    res = with_total_row(g, "product", "Total", tot)
    return res.select("product", "qty", F.col("revenue").cast("double").alias("revenue"),
                      F.col("cost").cast("double").alias("cost"),
                      (F.col("revenue") - F.col("cost")).cast("double").alias("profit"))


PLAN_FACTOR = 100


@report("budget_vs_actual", "A21 J2 Q7 R09", sql=f"""
WITH plan AS (SELECT p_brand, SUM(CAST(p_retailprice AS DECIMAL(18,2))) * {PLAN_FACTOR} AS planned FROM part GROUP BY p_brand),
act AS (SELECT p_brand,
               SUM(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END)
             - SUM(CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS actual
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand)
SELECT plan.p_brand, CAST(planned AS DOUBLE) AS planned, CAST(COALESCE(actual, 0) AS DOUBLE) AS actual,
       ROUND(CAST(planned AS DOUBLE) / NULLIF(CAST(COALESCE(actual, 0) AS DOUBLE), 0), 4) AS planned_over_actual,
       ROUND(CAST(COALESCE(actual, 0) AS DOUBLE) / NULLIF(CAST(planned AS DOUBLE), 0), 4) AS actual_over_planned
FROM plan LEFT JOIN act ON plan.p_brand = act.p_brand
""")
def budget_vs_actual(spark, root):
    """Planned amount per budget line against actual (credit - debit, 0 when none) with both
    ratios (the report divides planned by actual), guarded against a zero divisor."""
    t = Tables(spark, root)
    plan = t.part.groupBy("p_brand").agg((F.sum(dec("p_retailprice")) * PLAN_FACTOR).alias("planned"))
    amt = dec("l_extendedprice")
    act = (t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
                     .groupBy("p_brand").agg(
                         (F.sum(F.when(F.col("l_returnflag") == "R", amt).otherwise(F.lit(0)))
                          - F.sum(F.when(F.col("l_returnflag") != "R", amt).otherwise(F.lit(0)))).alias("actual")))
    j = plan.join(act, "p_brand", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return j.select("p_brand", F.col("planned").cast("double").alias("planned"), F.col("actual").cast("double").alias("actual"),
                    ratio("planned", "actual").alias("planned_over_actual"),
                    ratio("actual", "planned").alias("actual_over_planned"))


@report("reconcile_headers", "A20 J1", sql="""
WITH d AS (SELECT l_orderkey,
                  SUM(ROUND(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))) * (1 + CAST(l_tax AS DECIMAL(18,2))), 2)) AS detail_total
           FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS declared,
       CAST(detail_total AS DOUBLE) AS detail_total,
       CASE WHEN CAST(o_totalprice AS DECIMAL(18,2)) <> detail_total THEN 'Revisar' ELSE 'Cuadrada' END AS status,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) - detail_total AS DOUBLE) AS difference
FROM orders JOIN d ON o_orderkey = l_orderkey
""")
def reconcile_headers(spark, root):
    """Declared header amount against the sum of its lines (net of discount, plus tax);
    headers without lines do not appear."""
    t = Tables(spark, root)
    h = t.orders.select("o_orderkey", dec("o_totalprice").alias("declared"))
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    amount = F.round(line_amount() * (F.lit(1).cast("decimal(3,2)") + dec("l_tax")), 2)
    r = reconcile(h, lines, "o_orderkey", "declared", amount)
    return r.select("o_orderkey", F.col("declared").cast("double").alias("declared"),
                    F.col("detail_total").cast("double").alias("detail_total"), "status",
                    (F.col("declared") - F.col("detail_total")).cast("double").alias("difference"))


_INV_CELLS = [(f"{m}_{c}", c, sql) for m, sql in (("qty", "CAST(l_quantity AS DECIMAL(18,2))"), ("amt", SQL_LINE_AMOUNT)) for c in CLASSES]


@report("invoice_set", "R33 R35 R44 A11 A12 A13 J16 E1 E16 E29 O3 O6", sql=f"""
WITH m(ptype, cls) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in PRODUCT_CLASS)}),
l AS (SELECT l_orderkey, {", ".join(f"SUM({sql}) FILTER (WHERE COALESCE(cls, 'otros') = '{c}') AS {n}" for n, c, sql in _INV_CELLS)},
             SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2))) FILTER (WHERE l_tax >= {VAT_FROM}) AS tax_vat,
             SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2))) FILTER (WHERE l_tax IS NULL OR l_tax < {VAT_FROM}) AS tax_fuel
      FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN m ON p_type = m.ptype GROUP BY l_orderkey),
d AS (SELECT *, {_DOCNUM_SQL} AS docnum FROM orders),
p AS (SELECT *, {SQL_MARK} AS pos FROM d)
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, docnum, CASE WHEN pos IS NOT NULL THEN substr(docnum, 1, pos - 1) END AS series,
       TRY_CAST(CASE WHEN pos IS NOT NULL THEN substr(docnum, pos + 1) END AS BIGINT) AS seq, c_name AS partner,
       {sql_decode("o_orderstatus", STATUS_LABELS)} AS state, {sql_decode("o_orderstatus", STATUS_RANK)} AS state_rank,
       {", ".join(f"CAST(ROUND(COALESCE({c}, 0), 2) AS DOUBLE) AS {c}" for c in [n for n, _, _ in _INV_CELLS] + ["tax_vat", "tax_fuel"])},
       CAST(ROUND({" + ".join(f"COALESCE(qty_{c}, 0)" for c in CLASSES)}, 2) AS DOUBLE) AS volume
FROM p LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN l ON o_orderkey = l_orderkey
""")
def invoice_set(spark, root):
    """The invoice listing in one row per document: number split into series and sequence,
    state label, quantity and amount per product class, taxes by kind and the summed volume,
    sorted by the states' own rank, series and sequence. One pass over the lines; documents
    without lines or partner stay."""
    t = Tables(spark, root)
    m = values(spark, PRODUCT_CLASS, "ptype string, cls string")
    li = (t.lineitem.join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"), "left")
                    .join(m, F.col("p_type") == F.col("ptype"), "left").withColumn("cls", F.coalesce("cls", F.lit("otros"))))
    kind = F.when(F.col("l_tax") >= VAT_FROM, "vat").otherwise("fuel")
    sums = li.groupBy("l_orderkey").agg(
        *[cell("cls", c, dec("l_quantity")).alias(f"qty_{c}") for c in CLASSES],
        *[cell("cls", c, line_amount()).alias(f"amt_{c}") for c in CLASSES],
        *[cell(kind, k, dec("l_extendedprice") * dec("l_tax")).alias(f"tax_{k}") for k in ("vat", "fuel")])
    d = t.orders.withColumn("docnum", docnum())
    series, seq = split_docnum("docnum")
    j = (d.join(t.customer.select("c_custkey", F.col("c_name").alias("partner")), F.col("o_custkey") == F.col("c_custkey"), "left")
          .join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    volume = z(f"qty_{CLASSES[0]}")
    for c in CLASSES[1:]:
        volume = volume + z(f"qty_{c}")
    r = j.select("o_orderkey", as_date("o_orderdate").alias("day"), "docnum", series.alias("series"), seq.alias("seq"), "partner",
                 decode(F.col("o_orderstatus"), STATUS_LABELS).alias("state"),
                 decode(F.col("o_orderstatus"), STATUS_RANK).alias("state_rank"),
                 *[out(z(c)).alias(c) for c in [n for n, _, _ in _INV_CELLS] + ["tax_vat", "tax_fuel"]], out(volume).alias("volume"))
    return r.orderBy("state_rank", "series", "seq", "o_orderkey")


# The three fuels, the account group that stands for each, and its subsidy per gallon.
FUELS = [("super", "PROMO", "0.50"), ("regular", "ECONOMY", "0.40"), ("diesel", "LARGE", "0.30")]
FUEL_COMPANY = ("AUTOMOBILE", "BUILDING", "MACHINERY")
LOCAL_BRAND = "Brand#1"


def _fuel_sql() -> str:
    amount, tax = _weighted_parts()
    sums, stock = [], []
    for n, g, _ in FUELS:
        sums += [f"COALESCE(SUM(l_quantity) FILTER (WHERE p_type = '{g}' AND today), 0) AS gal_{n}",
                 f"COALESCE(SUM(l_quantity) FILTER (WHERE p_type = '{g}' AND NOT today), 0) AS next_{n}",
                 f"CAST(SUM({amount}) FILTER (WHERE p_type = '{g}' AND today) AS DOUBLE) AS sub_{n}",
                 f"CAST(SUM({amount} * 1.12 + {tax}) FILTER (WHERE p_type = '{g}' AND today) AS DOUBLE) AS tax_{n}"]
        stock += [f"COALESCE(SUM(p_size) FILTER (WHERE p_type = '{g}' AND p_brand {op} '{LOCAL_BRAND}'), 0) AS {w}_{n}"
                  for w, op in (("loc", "="), ("imp", "<>"))]
    rows = []
    for pos, name, cellsql, total in (
            (1, "Venta del dia (Gal)", "gal_{n}", True), (2, "Venta del dia (BBLS)", "gal_{n} / 42.0", True),
            (3, "Precio con impuestos", "ROUND(tax_{n} / NULLIF(gal_{n}, 0) + {s}, 5)", False),
            (4, "Precio sin impuestos (US$ cents)", f"ROUND((sub_{{n}} / NULLIF(gal_{{n}}, 0) + {{s}} / 1.12) / {EXCHANGE} * 100, 5)", False),
            (5, "Dia siguiente (Gal)", "next_{n}", True), (6, "Dia siguiente (BBLS)", "next_{n} / 42.0", True),
            (7, "Existencia importacion", "imp_{n}", True), (8, "Existencia local", "loc_{n}", True),
            (9, "Valor importacion", "imp_{n} * price_imp", True), (10, "Valor local", "loc_{n} * price_loc", True)):
        cells = [cellsql.format(n=n, s=s) for n, _, s in FUELS]
        all_of = " + ".join(f"COALESCE({c}, 0)" for c in cells) if total else "0"
        rows.append(f"SELECT {pos} AS pos, '{name}' AS metric, {', '.join(f'CAST(ROUND({c}, 5) AS DOUBLE) AS {f[0]}' for c, f in zip(cells, FUELS))}, "
                    f"CAST(ROUND({all_of}, 5) AS DOUBLE) AS total FROM g, s")
    return f"""
WITH l AS (SELECT lineitem.*, p_type, CAST(l_shipdate AS DATE) = DATE '{STACK_DAY}' AS today FROM lineitem JOIN part ON l_partkey = p_partkey
           WHERE CAST(l_shipdate AS DATE) IN (DATE '{STACK_DAY}', DATE '{STACK_DAY}' + INTERVAL 1 DAY)
             AND l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey
                                WHERE o_orderstatus <> 'P' AND c_mktsegment IN {FUEL_COMPANY})),
g AS (SELECT {", ".join(sums)} FROM l),
s AS (SELECT {", ".join(stock)},
             {", ".join(f"""CAST(SUM(CAST(p_retailprice AS DECIMAL(18,2))) FILTER (WHERE p_brand {op} '{LOCAL_BRAND}') AS DOUBLE)
             / NULLIF(COUNT(p_retailprice) FILTER (WHERE p_brand {op} '{LOCAL_BRAND}'), 0) AS price_{w}""" for w, op in (("loc", "="), ("imp", "<>")))}
      FROM part)
""" + "\nUNION ALL ".join(rows)


@report("fuel_day", "R42 A14 A9 E20 E29 E30 E31 O8 S5", sql=_fuel_sql())
def fuel_day(spark, root, day=STACK_DAY, exchange=EXCHANGE, companies=FUEL_COMPANY, subsidies=None):
    """The fuel report of one day, a column per fuel and a total: volume sold, both average
    prices with the fuel's subsidy (total 0; NULL without sales), the next day's volume, and
    imported and local stock with its value at the average price. Cancelled documents and
    other companies' are left out. All figures come from one aggregate over two days of lines
    and one over the products."""
    t = Tables(spark, root)
    per = {n: float((subsidies or {}).get(n, s)) for n, _, s in FUELS}
    lines, today = _two_days(t.lineitem, day)
    own = t.orders.where(F.col("o_orderstatus") != "P").join(
        t.customer.where(in_list("c_mktsegment", companies)), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    j = (lines.join(own.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
              .join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")))
    with_tax = line_amount() * F.lit("1.12").cast("decimal(4,2)") + dec("l_extendedprice") * dec("l_tax")
    sums, stock = [], []
    local = F.col("p_brand") == LOCAL_BRAND
    for n, g, _ in FUELS:
        sold = (F.col("p_type") == g) & today
        sums += [F.coalesce(F.sum(F.when(sold, F.col("l_quantity"))), F.lit(0.0)).alias(f"gal_{n}"),
                 F.coalesce(F.sum(F.when((F.col("p_type") == g) & ~today, F.col("l_quantity"))), F.lit(0.0)).alias(f"next_{n}"),
                 F.sum(F.when(sold, line_amount())).alias(f"sub_{n}"), F.sum(F.when(sold, with_tax)).alias(f"tax_{n}")]
        stock += [F.coalesce(F.sum(F.when((F.col("p_type") == g) & at, F.col("p_size"))), F.lit(0)).alias(f"{w}_{n}")
                  for w, at in (("loc", local), ("imp", ~local))]
    price = dec("p_retailprice")
    stock += [ratio(F.sum(F.when(at, price)), F.count(F.when(at, price)), None).alias(f"price_{w}")
              for w, at in (("loc", local), ("imp", ~local))]
    one = cross_scalar(j.agg(*sums), t.part.agg(*stock))
    col = lambda name: lambda n: F.col(f"{name}_{n}")
    barrels = lambda name: lambda n: F.col(f"{name}_{n}") / 42.0
    rows = [("Venta del dia (Gal)", col("gal"), True), ("Venta del dia (BBLS)", barrels("gal"), True),
            ("Precio con impuestos", lambda n: ratio(f"tax_{n}", f"gal_{n}", None) + per[n], False),
            ("Precio sin impuestos (US$ cents)",
             lambda n: (ratio(f"sub_{n}", f"gal_{n}", None) + per[n] / 1.12) / F.lit(exchange) * 100, False),
            ("Dia siguiente (Gal)", col("next"), True), ("Dia siguiente (BBLS)", barrels("next"), True),
            ("Existencia importacion", col("imp"), True), ("Existencia local", col("loc"), True),
            ("Valor importacion", lambda n: F.col(f"imp_{n}") * F.col("price_imp"), True),
            ("Valor local", lambda n: F.col(f"loc_{n}") * F.col("price_loc"), True)]

    def total(value):
        a, b, c = [F.coalesce(value(n).cast("double"), F.lit(0.0)) for n, _, _ in FUELS]
        return a + b + c

    listed = F.array(*[F.struct(F.lit(i + 1).alias("pos"), F.lit(name).alias("metric"),
                                *[F.round(value(n).cast("double"), 5).alias(n) for n, _, _ in FUELS],
                                (F.round(total(value), 5) if summed else F.lit(0.0)).alias("total"))
                       for i, (name, value, summed) in enumerate(rows)])
    return one.select(F.inline(listed)).orderBy("pos")
