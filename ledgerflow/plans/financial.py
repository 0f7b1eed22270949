"""Financial statements (report jobs R05, R13-R16, R22) on the account hierarchy of the
test tables: level 1 = part type, level 2 = brand, level 3 = size band, level 4 = the
account (part key, its code compared as a number)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerflow.functions.dates import as_date, prev_month_end
from ledgerflow.functions.money import dec
from ledgerflow.operators import scan
from ledgerflow.operators.bands import with_breaks
from ledgerflow.operators.breaks import Level, nested_breaks
from ledgerflow.operators.pivot import crosstab_totals
from ledgerflow.operators.spread import join_per_key
from ledgerflow.operators.totals import cross_scalar
from ledgerflow.plans.aggregates import TAG_SETS
from ledgerflow.plans.common import SQL_SIGNED, signed_amount
from ledgerflow.plans.ledger import LINE_ORDER
from ledgerflow.plans.registry import report
from ledgerflow.sources import Tables

TB_FROM, TB_TO = dt.date(1999, 4, 1), dt.date(1999, 9, 30)
SQL_LEVELS = ("p_type AS l1, p_brand AS l2, 'S' || CAST(p_size // 10 AS VARCHAR) AS l3, p_partkey")


def accounts(t: Tables):
    """Accounts with their four hierarchy levels; only accounts whose levels are all set."""
    p = t.part.where((F.col("p_partkey") >= 0) & (F.col("p_size") > 0) & (F.length("p_type") > 0)
                     & (F.length("p_brand") > 0))
    return p.select(F.col("p_type").alias("l1"), F.col("p_brand").alias("l2"),
                    F.concat(F.lit("S"), F.floor(F.col("p_size") / 10).cast("string")).alias("l3"), "p_partkey")


def _posted_lines(t: Tables):
    posted = t.orders.where(F.col("o_orderstatus") == "F").select("o_orderkey")
    return t.lineitem.join(posted, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")


_TB_SQL = f"""
WITH acc AS (SELECT {SQL_LEVELS} FROM part WHERE p_partkey >= 0 AND p_size > 0 AND length(p_type) > 0 AND length(p_brand) > 0),
ln AS (SELECT l_partkey, CAST(l_shipdate AS DATE) AS d, l_returnflag, CAST(l_extendedprice AS DECIMAL(18,2)) AS amt
       FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
         AND CAST(l_shipdate AS DATE) <= DATE '{TB_TO}'),
leaf AS (
  SELECT l1, l2, l3, p_partkey,
         SUM(CASE WHEN d <= DATE '{TB_FROM}' - INTERVAL 1 DAY THEN CASE WHEN l_returnflag = 'R' THEN -amt ELSE amt END ELSE 0 END) AS opening,
         SUM(CASE WHEN d >= DATE '{TB_FROM}' AND l_returnflag <> 'R' THEN amt ELSE 0 END) AS debit,
         SUM(CASE WHEN d >= DATE '{TB_FROM}' AND l_returnflag = 'R' THEN amt ELSE 0 END) AS credit
  FROM ln JOIN acc ON l_partkey = p_partkey GROUP BY l1, l2, l3, p_partkey),
leaf2 AS (SELECT *, ROUND(debit - credit, 2) AS movement, opening + debit - credit AS closing FROM leaf)
SELECT l1, l2, l3, p_partkey, GROUPING(l1, l2, l3, p_partkey) AS gid,
       CAST(SUM(opening) AS DOUBLE) AS opening, CAST(SUM(debit) AS DOUBLE) AS debit, CAST(SUM(credit) AS DOUBLE) AS credit,
       CAST(SUM(movement) AS DOUBLE) AS movement, CAST(SUM(closing) AS DOUBLE) AS closing,
       CAST(SUM(abs(movement)) AS DOUBLE) AS abs_movement, CAST(SUM(abs(closing)) AS DOUBLE) AS abs_closing
FROM leaf2 GROUP BY ROLLUP (l1, l2, l3, p_partkey)
"""


@report("trial_balance", "R13 B17 B1 B2 B5 B7 W8 A2 E1 E3 P9 O2 Q20 Q15", sql=_TB_SQL)
def trial_balance(spark, root, start=TB_FROM, end=TB_TO):
    """Analytical trial balance: opening (posted lines up to the day before ``start``),
    debit, credit, movement and closing per account, with totals on the three upper
    levels and overall from one leaf aggregation rolled up (no repeated scans); the
    absolute movement and closing sums are the overall lines of the report."""
    t = Tables(spark, root)
    d = as_date("l_shipdate")
    amt = dec("l_extendedprice")
    ln = _posted_lines(t).where(d <= F.lit(end))
    j = ln.join(accounts(t), F.col("l_partkey") == F.col("p_partkey"))
    zero = F.lit(0)
    leaf = j.groupBy("l1", "l2", "l3", "p_partkey").agg(
        F.sum(F.when(d <= F.date_sub(F.lit(start), 1), signed_amount()).otherwise(zero)).alias("opening"),
        F.sum(F.when((d >= F.lit(start)) & (F.col("l_returnflag") != "R"), amt).otherwise(zero)).alias("debit"),
        F.sum(F.when((d >= F.lit(start)) & (F.col("l_returnflag") == "R"), amt).otherwise(zero)).alias("credit"))
    leaf = (leaf.withColumn("movement", F.round(F.col("debit") - F.col("credit"), 2))
                .withColumn("closing", F.col("opening") + F.col("debit") - F.col("credit")))
    r = crosstab_totals(leaf, ["l1", "l2", "l3", "p_partkey"], [],
                        [F.sum(c).cast("double").alias(c) for c in ("opening", "debit", "credit", "movement", "closing")]
                        + [F.sum(F.abs("movement")).cast("double").alias("abs_movement"),
                           F.sum(F.abs("closing")).cast("double").alias("abs_closing")])
    return r.select("l1", "l2", "l3", "p_partkey", F.col("gid").cast("long").alias("gid"), "opening", "debit", "credit",
                    "movement", "closing", "abs_movement", "abs_closing")


BS_END = dt.date(2000, 6, 30)
CAPITAL, LIABILITIES = "LARGE", "MEDIUM"


def _net_income_sql(end: dt.date) -> str:
    sums = ", ".join(f"abs(SUM({SQL_SIGNED}) FILTER (WHERE p_type = '{g}' AND p_brand = '{b}')) AS {n}"
                     for n, (g, b) in TAG_SETS.items())
    return f"""SELECT (COALESCE(gross, 0) - COALESCE(operating, 0)) + COALESCE(fin_income, 0) - COALESCE(fin_cost, 0) AS net_income
      FROM (SELECT {sums} FROM lineitem JOIN part ON l_partkey = p_partkey
            WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
              AND CAST(l_shipdate AS DATE) BETWEEN DATE '{end.year}-01-01' AND DATE '{end}')"""


def _net_income(j, end):
    """One row: the year's net income from posted lines with their ``p_type`` and ``p_brand``."""
    in_year = j.where(as_date("l_shipdate") >= F.trunc(F.lit(end), "YEAR"))
    tags = in_year.agg(*[F.abs(F.sum(F.when((F.col("p_type") == g) & (F.col("p_brand") == b), signed_amount()))).alias(n)
                         for n, (g, b) in TAG_SETS.items()])
    z = {n: F.coalesce(F.col(n), F.lit(0)) for n in TAG_SETS}
    return tags.select(((z["gross"] - z["operating"]) + z["fin_income"] - z["fin_cost"]).alias("net_income"))


@report("balance_sheet", "R15 J8 A23 B14 B5 W1 E19", sql=f"""
WITH bal AS (
  SELECT p_type AS l1, p_brand AS l2, SUM({SQL_SIGNED}) AS balance
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND CAST(l_shipdate AS DATE) <= DATE '{BS_END}'
  GROUP BY p_type, p_brand),
r AS (SELECT l1, l2, GROUPING(l1, l2) AS gid, SUM(balance) AS balance FROM bal GROUP BY ROLLUP (l1, l2)),
ni AS ({_net_income_sql(BS_END)}),
rows AS (
  SELECT CAST(NULL AS VARCHAR) AS line, l1, l2, gid, balance FROM r
  UNION ALL
  SELECT 'check', NULL, NULL, NULL,
         abs(SUM(CASE WHEN l1 = '{CAPITAL}' THEN balance ELSE 0 END) + SUM(CASE WHEN l1 = '{LIABILITIES}' THEN balance ELSE 0 END))
  FROM r WHERE gid = 1)
SELECT line, l1, l2, gid, CAST(balance + CASE WHEN line = 'check' THEN net_income ELSE 0 END AS DOUBLE) AS balance,
       CAST(net_income AS DOUBLE) AS net_income
FROM rows, ni
""")
def balance_sheet(spark, root, end=BS_END):
    """Balance sheet: posted balances up to ``end`` by group and subgroup with totals, the
    year's net income (four tagged sets, one filtered aggregation) on every row, and the
    check line abs(capital + liabilities) + net income."""
    t = Tables(spark, root)
    posted = _posted_lines(t).where(as_date("l_shipdate") <= F.lit(end))
    j = posted.join(t.part.select("p_partkey", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    bal = j.groupBy(F.col("p_type").alias("l1"), F.col("p_brand").alias("l2")).agg(F.sum(signed_amount()).alias("balance"))
    r = crosstab_totals(bal, ["l1", "l2"], [], [F.sum("balance").alias("balance")])
    ni = _net_income(j, end)
    groups = r.where(F.col("gid") == 1)
    check = groups.agg(F.abs(F.sum(F.when(F.col("l1") == CAPITAL, F.col("balance")).otherwise(F.lit(0)))
                             + F.sum(F.when(F.col("l1") == LIABILITIES, F.col("balance")).otherwise(F.lit(0)))).alias("balance"))
    rows = r.select(F.lit(None).cast("string").alias("line"), "l1", "l2", F.col("gid").cast("long").alias("gid"), "balance")
    check_row = check.select(F.lit("check").alias("line"), F.lit(None).cast("string").alias("l1"),
                             F.lit(None).cast("string").alias("l2"), F.lit(None).cast("long").alias("gid"), "balance")
    u = cross_scalar(rows.unionByName(check_row), ni)                           # net income: one row
    return u.select("line", "l1", "l2", "gid",
                    (F.col("balance") + F.when(F.col("line") == "check", F.col("net_income")).otherwise(F.lit(0)))
                    .cast("double").alias("balance"), F.col("net_income").cast("double").alias("net_income"))


IS_FROM, IS_TO = dt.date(2000, 1, 1), dt.date(2000, 12, 31)
# The three top groups of the income statement (revenue, costs, other).
IS_GROUPS = [("revenue", "ECONOMY"), ("costs", "PROMO"), ("other", "STANDARD")]


@report("income_statement", "R16 B13 A4 E19 J8", sql=f"""
WITH s AS (
  SELECT {", ".join(f"abs(SUM({SQL_SIGNED}) FILTER (WHERE p_type = '{g}')) AS {n}" for n, g in IS_GROUPS)}
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '{IS_FROM}' AND DATE '{IS_TO}')
SELECT line, CAST(amount AS DOUBLE) AS amount, pos FROM (
  SELECT 'revenue' AS line, revenue AS amount, 1 AS pos FROM s
  UNION ALL SELECT 'costs', costs, 2 FROM s
  UNION ALL SELECT 'gross_profit', revenue - costs, 3 FROM s
  UNION ALL SELECT 'other', other, 4 FROM s
  UNION ALL SELECT 'net_profit', revenue - costs - other, 5 FROM s)
""")
def income_statement(spark, root, start=IS_FROM, end=IS_TO):
    """Income statement: absolute totals of three top groups over the period (one filtered
    aggregation instead of the same block four times) and the derived profit lines."""
    t = Tables(spark, root)
    li = t.lineitem.where(as_date("l_shipdate").between(F.lit(start), F.lit(end)))
    j = li.join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    s = j.agg(*[F.abs(F.sum(F.when(F.col("p_type") == g, signed_amount()))).alias(n) for n, g in IS_GROUPS])
    rev, cost, oth = F.col("revenue"), F.col("costs"), F.col("other")
    lines = [("revenue", rev), ("costs", cost), ("gross_profit", rev - cost), ("other", oth),
             ("net_profit", rev - cost - oth)]
    arr = F.array(*[F.struct(F.lit(n).alias("line"), c.cast("double").alias("amount"), F.lit(i + 1).alias("pos"))
                    for i, (n, c) in enumerate(lines)])
    return s.select(F.inline(arr))


DRAFT_SEED = "0.00"


@report("draft_balance", "R14 B15 P9 A2 J1", sql=f"""
WITH g AS (
  SELECT year(l_shipdate) AS yr, p_type, SUM({SQL_SIGNED}) AS balance
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE p_size > 0 AND p_retailprice > 0 AND p_partkey >= 0 AND length(p_brand) > 0
  GROUP BY 1, 2)
SELECT yr, p_type, CAST(balance AS DOUBLE) AS balance,
       CAST({DRAFT_SEED} + SUM(balance) OVER (ORDER BY yr, p_type ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS seeded
FROM g
""")
def draft_balance(spark, root, seed=DRAFT_SEED):
    """Balance by top group per year with a seeded running sum over all years and groups, never
    reset (the window holds one row per year and group, so it is bounded)."""
    t = Tables(spark, root)
    acc = t.part.where((F.col("p_size") > 0) & (F.col("p_retailprice") > 0) & (F.col("p_partkey") >= 0)
                       & (F.length("p_brand") > 0)).select("p_partkey", "p_type")
    g = (t.lineitem.join(acc, F.col("l_partkey") == F.col("p_partkey"))
                   .groupBy(F.year("l_shipdate").alias("yr"), "p_type").agg(F.sum(signed_amount()).alias("balance")))
    w = Window.orderBy("yr", "p_type").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return g.select("yr", "p_type", F.col("balance").cast("double").alias("balance"),
                    (F.lit(seed).cast("decimal(18,2)") + F.sum("balance").over(w)).cast("double").alias("seeded"))


BIG_SIZE = 25


@report("tag_inventory", "R05 J7 B1 B2 A2 E4 Q6", sql=f"""
WITH bridge AS (SELECT p_partkey AS acc, 'T_' || p_type AS tag FROM part
                UNION ALL SELECT p_partkey, 'T_BIG' FROM part WHERE p_size > {BIG_SIZE}),
bal AS (SELECT l_partkey, SUM({SQL_SIGNED}) AS balance FROM lineitem GROUP BY l_partkey),
r AS (SELECT tag, p_brand, p_partkey, COALESCE(balance, 0) AS balance
      FROM bridge JOIN part ON acc = p_partkey LEFT JOIN bal ON l_partkey = p_partkey),
b AS (SELECT *, CASE WHEN lag(p_brand) OVER (PARTITION BY tag ORDER BY p_partkey) IS NOT DISTINCT FROM p_brand
                     THEN 0 ELSE 1 END AS brk FROM r),
runs AS (SELECT *, SUM(brk) OVER (PARTITION BY tag ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS run_id FROM b)
SELECT tag, p_brand, CAST(SUM(balance) AS DOUBLE) AS balance, count(*) AS n_accounts, count(DISTINCT run_id) AS n_runs
FROM runs GROUP BY tag, p_brand
""")
def tag_inventory(spark, root):
    """Balances of accounts grouped by tag (through a many-to-many bridge) and brand.
    ``balance`` and ``n_accounts`` use key semantics; ``n_runs`` counts the groups a
    control-break report prints when it lists accounts by code and breaks on brand."""
    t = Tables(spark, root)
    p = t.part
    bridge = (p.select(F.col("p_partkey").alias("acc"), F.concat(F.lit("T_"), "p_type").alias("tag"))
               .unionByName(p.where(F.col("p_size") > BIG_SIZE).select(F.col("p_partkey").alias("acc"), F.lit("T_BIG").alias("tag"))))
    bal = t.lineitem.groupBy("l_partkey").agg(F.sum(signed_amount()).alias("balance"))
    r = (bridge.join(p.select("p_partkey", "p_brand"), F.col("acc") == F.col("p_partkey"))
               .join(bal, F.col("l_partkey") == F.col("p_partkey"), "left")
               .select("tag", "p_brand", "p_partkey", F.coalesce("balance", F.lit(0)).alias("balance")))
    runs = with_breaks(r, ["p_brand"], ["p_partkey"], by=["tag"])
    return runs.groupBy("tag", "p_brand").agg(F.sum("balance").cast("double").alias("balance"),
                                              F.count(F.lit(1)).alias("n_accounts"),
                                              F.countDistinct("run_id").alias("n_runs"))


AL_FROM, AL_TO = dt.date(1999, 7, 1), dt.date(1999, 9, 30)
AL_ORDER = ["l_shipdate", "l_orderkey", *[c for c in LINE_ORDER if c != "l_shipdate"]]


@report("accumulator_ledger", "R22 B8 B9 B10 B11 B12 E9 Q12", sql=f"""
WITH op AS (SELECT l_partkey AS k, SUM({SQL_SIGNED}) AS opening FROM lineitem
            WHERE CAST(l_shipdate AS DATE) <= CAST(date_trunc('month', DATE '{AL_FROM}') - INTERVAL 1 DAY AS DATE) GROUP BY l_partkey),
m AS (SELECT {", ".join(AL_ORDER)}, {SQL_SIGNED} AS x
      FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '{AL_FROM}' AND DATE '{AL_TO}'),
f AS (SELECT m.*, COALESCE(opening, 0) AS opening,
             lag(x) OVER (PARTITION BY l_partkey ORDER BY {", ".join(AL_ORDER)}) AS prev_x FROM m LEFT JOIN op ON k = l_partkey),
g AS (SELECT *, SUM(CASE WHEN COALESCE(prev_x, 0) = 0 THEN 1 ELSE 0 END)
                  OVER (PARTITION BY l_partkey ORDER BY {", ".join(AL_ORDER)} ROWS UNBOUNDED PRECEDING) AS island FROM f),
acc AS (SELECT l_partkey AS a, SUM(GREATEST(x, 0)) AS group_debit, SUM(GREATEST(-x, 0)) AS group_credit,
               ANY_VALUE(opening) + SUM(x) AS group_year FROM f GROUP BY l_partkey),
tot AS (SELECT SUM(group_debit) AS td, SUM(group_credit) AS tc, SUM(group_year) AS ty FROM acc)
SELECT l_partkey, l_orderkey, l_linenumber, CAST(x AS DOUBLE) AS x, CAST(prev_x AS DOUBLE) AS prev_x,
       CAST(SUM(x) OVER (PARTITION BY l_partkey ORDER BY {", ".join(AL_ORDER)} ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS month_value,
       CAST(opening + SUM(x) OVER (PARTITION BY l_partkey, island ORDER BY {", ".join(AL_ORDER)} ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS year_value,
       CAST(opening AS DOUBLE) AS opening, CAST(group_debit AS DOUBLE) AS group_debit, CAST(group_credit AS DOUBLE) AS group_credit,
       CAST(group_debit - group_credit AS DOUBLE) AS group_month, CAST(group_year AS DOUBLE) AS group_year,
       CAST(td AS DOUBLE) AS total_debit, CAST(tc AS DOUBLE) AS total_credit, CAST(td - tc AS DOUBLE) AS total_month,
       CAST(ty AS DOUBLE) AS total_year
FROM g JOIN acc ON a = l_partkey, tot
""")
def accumulator_ledger(spark, root, start=AL_FROM, end=AL_TO):
    """Ledger with accumulator variables per account in line order: previous movement,
    running movement of the account (``month_value``, reset by the account only), and a year
    value that restarts at opening + movement whenever the previous movement is 0 or absent
    (else previous + movement). The opening is every line up to the end of the month before
    ``start``. Group totals per account (``group_year`` = opening + movement) and report
    totals, where ``total_year`` takes each account's ``group_year`` once."""
    t = Tables(spark, root)
    d = as_date("l_shipdate")
    op = (t.lineitem.where(d <= prev_month_end(F.lit(start))).groupBy("l_partkey")
                    .agg(F.sum(signed_amount()).alias("opening")))
    m = (t.lineitem.where(d.between(F.lit(start), F.lit(end)))
                   .select(*AL_ORDER, signed_amount().alias("x")))
    by, zero = ["l_partkey"], F.lit(0)
    chunks = scan.plan_chunks(spark, m.count())       # the join leaves the number of rows
    m = join_per_key(m, op, by, "left").withColumn("opening", F.coalesce("opening", F.lit(0)))
    # One pass: the account's rows, and inside them the stretches between two restarts.
    levels = [Level("acc", F.col("l_partkey"), running=True), Level("year", after=F.coalesce("x", zero) == 0, running=True, totals=False)]
    c = nested_breaks(m, levels, ["l_partkey", *[x for x in AL_ORDER if x != "l_partkey"]],
                      [("x", F.col("x")), ("debit", F.greatest("x", zero)), ("credit", F.greatest(-F.col("x"), zero))],
                      [("prev_x", F.col("x"), "acc")], num_chunks=chunks)
    c = c.withColumnsRenamed({"acc_debit": "group_debit", "acc_credit": "group_credit"}) \
         .withColumn("group_year", F.col("opening") + F.col("acc_x"))
    totals = c.where(F.col("starts") == 1).agg(               # each account once, at its first line
        F.sum("group_debit").alias("total_debit"), F.sum("group_credit").alias("total_credit"), F.sum("group_year").alias("total_year"))
    c = cross_scalar(c, totals)
    sums = {"group_debit": F.col("group_debit"), "group_credit": F.col("group_credit"),
            "group_month": F.col("group_debit") - F.col("group_credit"), "group_year": F.col("group_year"),
            "total_debit": F.col("total_debit"), "total_credit": F.col("total_credit"),
            "total_month": F.col("total_debit") - F.col("total_credit"), "total_year": F.col("total_year")}
    return c.select("l_partkey", "l_orderkey", "l_linenumber", F.col("x").cast("double").alias("x"),
                    F.col("prev_x").cast("double").alias("prev_x"),
                    F.col("acc_x_running").cast("double").alias("month_value"),
                    (F.col("opening") + F.col("year_x_running")).cast("double").alias("year_value"),
                    F.col("opening").cast("double").alias("opening"), *[v.cast("double").alias(k) for k, v in sums.items()])


@report("balance_sheet_accounts", "R15 B17 B1 B2 J8 A23 W8 P9", sql=f"""
WITH acc AS (SELECT {SQL_LEVELS} FROM part WHERE p_partkey >= 0 AND p_size > 0 AND length(p_type) > 0 AND length(p_brand) > 0),
leaf AS (
  SELECT l1, l2, l3, p_partkey, SUM(CASE WHEN CAST(l_shipdate AS DATE) < DATE '{BS_END.year}-01-01' THEN {SQL_SIGNED} ELSE 0 END) AS opening,
         SUM(CASE WHEN CAST(l_shipdate AS DATE) >= DATE '{BS_END.year}-01-01' THEN {SQL_SIGNED} ELSE 0 END) AS movement
  FROM lineitem JOIN acc ON l_partkey = p_partkey
  WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND CAST(l_shipdate AS DATE) <= DATE '{BS_END}'
  GROUP BY l1, l2, l3, p_partkey),
ni AS ({_net_income_sql(BS_END)})
SELECT l1, l2, l3, p_partkey, GROUPING(l1, l2, l3, p_partkey) AS gid, CAST(SUM(opening) AS DOUBLE) AS opening,
       CAST(SUM(movement) AS DOUBLE) AS movement, CAST(SUM(opening + movement) AS DOUBLE) AS balance,
       CAST(ANY_VALUE(net_income) AS DOUBLE) AS net_income
FROM leaf, ni GROUP BY ROLLUP (l1, l2, l3, p_partkey)
""")
def balance_sheet_accounts(spark, root, end=BS_END):
    """The balance sheet with its account rows: opening (posted lines before the year of
    ``end``), movement of the year and balance per account, on four levels and overall from
    one leaf aggregation, the year's net income on every row; by level codes, totals first."""
    t = Tables(spark, root)
    d = as_date("l_shipdate")
    posted = _posted_lines(t).where(d <= F.lit(end))
    j = posted.join(t.part.select("p_partkey", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    ln = posted.join(accounts(t), F.col("l_partkey") == F.col("p_partkey"))
    first, zero = F.trunc(F.lit(end), "YEAR"), F.lit(0)
    levels = ["l1", "l2", "l3", "p_partkey"]
    leaf = ln.groupBy(*levels).agg(F.sum(F.when(d < first, signed_amount()).otherwise(zero)).alias("opening"),
                                   F.sum(F.when(d >= first, signed_amount()).otherwise(zero)).alias("movement"))
    r = crosstab_totals(leaf, levels, [], [F.sum("opening").alias("opening"), F.sum("movement").alias("movement"),
                                           F.sum(F.col("opening") + F.col("movement")).alias("balance")])
    r = cross_scalar(r, _net_income(j, end))
    return r.select(*levels, F.col("gid").cast("long").alias("gid"), *[
        F.col(c).cast("double").alias(c) for c in ("opening", "movement", "balance", "net_income")]).orderBy(*levels, "gid")


@report("income_statement_accounts", "R16 B13 B17 A2 A4 W8 E9", sql=f"""
WITH leaf AS (
  SELECT p_type AS l1, p_brand AS l2, p_partkey, SUM(CASE WHEN CAST(l_shipdate AS DATE) < DATE '{IS_FROM}' THEN {SQL_SIGNED} ELSE 0 END) AS opening,
         SUM(CASE WHEN CAST(l_shipdate AS DATE) >= DATE '{IS_FROM}' THEN {SQL_SIGNED} ELSE 0 END) AS movement
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE CAST(l_shipdate AS DATE) <= DATE '{IS_TO}' AND p_type IN {tuple(g for _, g in IS_GROUPS)}
  GROUP BY p_type, p_brand, p_partkey),
r AS (SELECT l1, l2, p_partkey, GROUPING(l1, l2, p_partkey) AS gid, SUM(opening) AS opening, SUM(movement) AS movement
      FROM leaf GROUP BY ROLLUP (l1, l2, p_partkey)),
s AS (SELECT {", ".join(f"COALESCE(abs(SUM(movement) FILTER (WHERE l1 = '{g}')), 0) AS {n}" for n, g in IS_GROUPS)} FROM leaf)
SELECT CASE gid WHEN 0 THEN 'account' WHEN 1 THEN 'subgroup' ELSE 'group' END AS line, l1, l2, p_partkey,
       CAST(opening AS DOUBLE) AS opening, CAST(movement AS DOUBLE) AS movement, CAST(opening + movement AS DOUBLE) AS closing
FROM r WHERE gid < 7
UNION ALL SELECT 'gross_profit', NULL, NULL, NULL, NULL, CAST(revenue - costs AS DOUBLE), NULL FROM s
UNION ALL SELECT 'net_profit', NULL, NULL, NULL, NULL, CAST(revenue - costs - other AS DOUBLE), NULL FROM s
""")
def income_statement_accounts(spark, root, start=IS_FROM, end=IS_TO):
    """The income statement with its account rows: opening (before ``start``), movement and
    closing per account, subgroup and top group, then the derived profit lines from the
    absolute movements of the groups; one leaf aggregation, in the groups' order."""
    t = Tables(spark, root)
    d, zero = as_date("l_shipdate"), F.lit(0)
    p = t.part.where(F.col("p_type").isin([g for _, g in IS_GROUPS])).select(
        F.col("p_type").alias("l1"), F.col("p_brand").alias("l2"), "p_partkey")
    levels = ["l1", "l2", "p_partkey"]
    leaf = (t.lineitem.where(d <= F.lit(end)).join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(*levels)
             .agg(F.sum(F.when(d < F.lit(start), signed_amount()).otherwise(zero)).alias("opening"),
                  F.sum(F.when(d >= F.lit(start), signed_amount()).otherwise(zero)).alias("movement")))
    r = crosstab_totals(leaf, levels, [], [F.sum("opening").alias("opening"), F.sum("movement").alias("movement")])
    line = F.when(F.col("gid") == 0, "account").when(F.col("gid") == 1, "subgroup").otherwise("group")
    num = lambda c: c.cast("double")
    place = sum((F.when(F.col("l1") == g, i + 1).otherwise(0) for i, (_, g) in enumerate(IS_GROUPS)), F.lit(0))
    rows = r.where(F.col("gid") < 7).select(line.alias("line"), *levels, num(F.col("opening")).alias("opening"),
                                            num(F.col("movement")).alias("movement"),
                                            num(F.col("opening") + F.col("movement")).alias("closing"), place.alias("_place"))
    s = leaf.agg(*[F.coalesce(F.abs(F.sum(F.when(F.col("l1") == g, F.col("movement")))), zero).alias(n) for n, g in IS_GROUPS])
    gross = F.col("revenue") - F.col("costs")
    none = F.lit(None)
    profit = s.select(F.inline(F.array(*[F.struct(
        F.lit(n).alias("line"), none.cast("string").alias("l1"), none.cast("string").alias("l2"),
        none.cast("bigint").alias("p_partkey"), none.cast("double").alias("opening"), num(v).alias("movement"),
        none.cast("double").alias("closing"), F.lit(9 + i).alias("_place"))
        for i, (n, v) in enumerate([("gross_profit", gross), ("net_profit", gross - F.col("other"))])])))
    return rows.unionByName(profit).orderBy("_place", *levels).drop("_place")


GL_FROM, GL_TO = dt.date(1998, 1, 1), dt.date(1998, 12, 31)
SKIP_CLASS = "8"


@report("general_ledger", "R23 W2 W3 W4 W8 A8 B1 B2 J8 O2 P7", sql=f"""
WITH ln AS (
  SELECT l_partkey, l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS d, {SQL_SIGNED} AS x FROM lineitem
  WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND CAST(l_shipdate AS DATE) <= DATE '{GL_TO}'
    AND NOT starts_with(CAST(l_partkey AS VARCHAR), '{SKIP_CLASS}')),
mv AS (SELECT * FROM ln WHERE d >= DATE '{GL_FROM}'),
op AS (SELECT l_partkey AS k, SUM(x) AS opening FROM ln WHERE d < DATE '{GL_FROM}' GROUP BY l_partkey),
sub AS (SELECT l_partkey AS a, COALESCE(ANY_VALUE(opening), 0) AS opening, SUM(x) AS subtotal, COALESCE(ANY_VALUE(opening), 0) + SUM(x) AS year_subtotal
        FROM mv LEFT JOIN op ON l_partkey = k GROUP BY l_partkey),
tot AS (SELECT SUM(abs(subtotal)) AS grand, SUM(abs(year_subtotal)) AS year_grand FROM sub)
SELECT l_partkey, l_orderkey, l_linenumber, CAST(x AS DOUBLE) AS amount,
       CAST(SUM(x) OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS DOUBLE) AS running, CAST(opening AS DOUBLE) AS opening,
       CAST(opening + SUM(x) OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS DOUBLE) AS year_running,
       CAST(subtotal AS DOUBLE) AS subtotal, CAST(year_subtotal AS DOUBLE) AS year_subtotal,
       CAST(grand AS DOUBLE) AS grand_total, CAST(year_grand AS DOUBLE) AS year_grand_total
FROM mv JOIN sub ON l_partkey = a, tot
""")
def general_ledger(spark, root, start=GL_FROM, end=GL_TO, skip_class=SKIP_CLASS):
    """The ledger with all its lines and totals: posted lines of the period, accounts of one
    class (the code's first digit) left out; running balance by document, opening once, year
    balance; each account's subtotals and the grand totals of absolute subtotals on its rows;
    by account code as a number, document and line."""
    t = Tables(spark, root)
    d = as_date("l_shipdate")
    ln = (_posted_lines(t).where((d <= F.lit(end)) & ~F.col("l_partkey").cast("string").startswith(skip_class))
          .select("l_partkey", "l_orderkey", "l_linenumber", d.alias("d"), signed_amount().alias("x")))
    by, order = ["l_partkey"], ["l_orderkey"]
    mv = scan.chunk_by_range(ln.where(F.col("d") >= F.lit(start)).drop("d"), by, order)
    lines = scan.scan_all(mv, by, order, [("running", "sum", F.col("x"), "range"), ("subtotal", "total", F.col("x"))])
    op = ln.where(F.col("d") < F.lit(start)).groupBy("l_partkey").agg(F.sum("x").alias("opening"))
    sub = (mv.groupBy("l_partkey").agg(F.sum("x").alias("subtotal")).join(op, "l_partkey", "left")
             .withColumn("opening", F.coalesce("opening", F.lit(0)))
             .withColumn("year_subtotal", F.col("opening") + F.col("subtotal")))
    totals = sub.agg(F.sum(F.abs("subtotal")).alias("grand_total"), F.sum(F.abs("year_subtotal")).alias("year_grand_total"))
    lines = join_per_key(lines, op, by, "left").withColumn("opening", F.coalesce("opening", F.lit(0)))
    j = cross_scalar(lines.withColumn("year_subtotal", F.col("opening") + F.col("subtotal")), totals)
    r = j.withColumn("year_running", F.col("opening") + F.col("running")).withColumnRenamed("x", "amount").select(
        "l_partkey", "l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in (
            "amount", "running", "opening", "year_running", "subtotal", "year_subtotal", "grand_total", "year_grand_total")])
    return r.orderBy("l_partkey", "l_orderkey", "l_linenumber", "amount")
