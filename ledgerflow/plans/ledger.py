"""Ledger reports: month spine balances, opening balances, running ledgers, account
sides, numbered lines, control-break runs and resettable accumulators.

Running values over raw lines use the chunked scans of ``operators.scan`` so that an
account (or user, or document) holding a large share of all rows is still processed by
many tasks; totals of a key come from the same scan.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerflow.functions.dates import as_date, prev_month_end
from ledgerflow.functions.money import dec
from ledgerflow.operators import intervals, scan
from ledgerflow.operators.spread import join_per_key
from ledgerflow.operators.balances import month_spine
from ledgerflow.operators.bands import with_breaks
from ledgerflow.operators.breaks import Level, nested_breaks
from ledgerflow.plans.common import SQL_SIGNED, signed_amount
from ledgerflow.plans.registry import report
from ledgerflow.session import ensure_checkpoint_dir
from ledgerflow.sources import PeriodBalances, Tables

@report("month_spine_balance", "S3 W1 J9 J2 E10 Q18", sql=f"""
WITH span AS (SELECT date_trunc('month', MIN(l_shipdate)) AS lo, date_trunc('month', MAX(l_shipdate)) AS hi FROM lineitem),
spine AS (
  SELECT p_type, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month
  FROM (SELECT DISTINCT p_type FROM part), span),
mv AS (SELECT p_type, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, SUM({SQL_SIGNED}) AS movement
       FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT spine.p_type, spine.month, year(spine.month) AS yr, month(spine.month) AS mon,
       CAST(COALESCE(movement, 0) AS DOUBLE) AS movement,
       CAST(SUM(COALESCE(movement, 0)) OVER (PARTITION BY spine.p_type ORDER BY spine.month) AS DOUBLE) AS balance
FROM spine LEFT JOIN mv ON spine.p_type = mv.p_type AND spine.month = mv.month
""")
def month_spine_balance(spark, root, start=None, end=None):
    """Cumulative balance per account group for every month from the first to the last
    movement, or from ``start`` to ``end`` (months without movements carry the balance
    forward; movements before ``start`` are in the first balance). The window is per account
    over at most one row per month, so its partitions are bounded by the calendar, not by
    the data."""
    t = Tables(spark, root)
    spine = month_spine(t.part.select("p_type").distinct(), t.lineitem.select(as_date("l_shipdate").alias("d")), start, end)
    month = F.trunc(as_date("l_shipdate"), "MM")
    first = F.trunc(F.lit(start).cast("date"), "MM")
    mv = (t.lineitem.join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
                    .groupBy("p_type", F.when(month < first, first).otherwise(month).alias("month"))
                    .agg(F.sum(F.when(month < first, F.lit(0)).otherwise(signed_amount())).alias("movement"),
                         F.sum(signed_amount()).alias("carried")))
    j = (spine.join(mv, ["p_type", "month"], "left")
              .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("movement", "carried")}))
    w = Window.partitionBy("p_type").orderBy("month")
    return j.select("p_type", "month", F.year("month").alias("yr"), F.month("month").alias("mon"),
                    F.col("movement").cast("double").alias("movement"),
                    F.sum("carried").over(w).cast("double").alias("balance"))


OB_FROM, OB_TO = dt.date(1999, 4, 15), dt.date(1999, 12, 31)


@report("opening_balance", "W8 E9 A2 Q21", sql=f"""
SELECT l_partkey,
       CAST(SUM(CASE WHEN CAST(l_shipdate AS DATE) < DATE '{OB_FROM}' THEN {SQL_SIGNED} ELSE 0 END) AS DOUBLE) AS opening,
       CAST(SUM(CASE WHEN CAST(l_shipdate AS DATE) <= CAST(date_trunc('month', DATE '{OB_FROM}') - INTERVAL 1 DAY AS DATE)
                     THEN {SQL_SIGNED} ELSE 0 END) AS DOUBLE) AS opening_month_end,
       CAST(SUM(CASE WHEN CAST(l_shipdate AS DATE) >= DATE '{OB_FROM}' THEN {SQL_SIGNED} ELSE 0 END) AS DOUBLE) AS movement,
       CAST(SUM({SQL_SIGNED}) AS DOUBLE) AS closing
FROM lineitem WHERE CAST(l_shipdate AS DATE) <= DATE '{OB_TO}'
GROUP BY l_partkey
""")
def opening_balance(spark, root, start=OB_FROM, end=OB_TO):
    """Opening (all lines before ``start``), movement in [start, end] and closing per account,
    in one aggregation; ``opening_month_end`` is the reference rule (up to the end of the
    previous month, which loses the days of ``start``'s month before ``start``)."""
    li = Tables(spark, root).lineitem
    d = as_date("l_shipdate")
    a = signed_amount()
    zero = F.lit(0)
    g = li.where(d <= F.lit(end)).groupBy("l_partkey").agg(
        F.sum(F.when(d < F.lit(start), a).otherwise(zero)).alias("opening"),
        F.sum(F.when(d <= prev_month_end(F.lit(start)), a).otherwise(zero)).alias("opening_month_end"),
        F.sum(F.when(d >= F.lit(start), a).otherwise(zero)).alias("movement"),
        F.sum(a).alias("closing"))
    return g.select("l_partkey", *[F.col(c).cast("double").alias(c)
                                   for c in ("opening", "opening_month_end", "movement", "closing")])


SO_FROM, SO_TO = dt.date(1998, 7, 15), dt.date(1999, 6, 30)
LOADED_TO, LATE_YEAR = dt.date(1999, 1, 1), 1996


@report("stored_openings", "S6 W8 W1 A2 P1 Q21", sql=f"""
SELECT l_partkey,
       CAST(SUM(CASE WHEN CAST(l_shipdate AS DATE) < DATE '{SO_FROM}' THEN {SQL_SIGNED} ELSE 0 END) AS DOUBLE) AS opening,
       CAST(SUM(CASE WHEN CAST(l_shipdate AS DATE) >= DATE '{SO_FROM}' THEN {SQL_SIGNED} ELSE 0 END) AS DOUBLE) AS movement,
       CAST(SUM({SQL_SIGNED}) AS DOUBLE) AS closing,
       count(*) FILTER (WHERE CAST(l_shipdate AS DATE) < DATE '{SO_FROM}') AS opening_lines
FROM lineitem WHERE CAST(l_shipdate AS DATE) <= DATE '{SO_TO}'
GROUP BY l_partkey
""")
def stored_openings(spark, root, start=SO_FROM, end=SO_TO, store=None):
    """Opening, movement and closing per account, the opening read from stored period balances:
    years, months of ``start``'s year, and only the lines of the month that ``start`` cuts.

    ``store`` is the folder of the balances, kept between runs and brought up to date here.
    Without one a fresh folder beside the checkpoints goes through the life of such a store: the
    months before ``LOADED_TO`` without the returns of one year, then all lines, so that
    the returns arrive late and only their months are summed anew."""
    li = Tables(spark, root).lineitem
    path = store or f"{ensure_checkpoint_dir(spark)}/period-balances-{uuid.uuid4().hex}"
    kept = PeriodBalances(spark, path, ["l_partkey"], "l_shipdate", [("amount", signed_amount()), ("lines", F.lit(1).cast("long"))])
    if store is None:
        late = (F.col("l_returnflag") == "R") & (F.year("l_shipdate") == LATE_YEAR)
        kept.refresh(li.where((F.col("l_shipdate") < F.lit(LOADED_TO)) & ~late))
    kept.refresh(li)
    before = kept.before(li, start).withColumnRenamed("amount", "opening").withColumnRenamed("lines", "opening_lines")
    mv = li.where(as_date("l_shipdate").between(F.lit(start), F.lit(end))) \
           .groupBy("l_partkey").agg(F.sum(signed_amount()).alias("movement"))
    j = before.join(mv, "l_partkey", "full")              # one row an account on both sides
    opening, movement = (F.coalesce(F.col(c), F.lit(0)) for c in ("opening", "movement"))
    return j.select("l_partkey", opening.cast("double").alias("opening"), movement.cast("double").alias("movement"),
                    (opening + movement).cast("double").alias("closing"),
                    F.coalesce(F.col("opening_lines"), F.lit(0).cast("long")).alias("opening_lines"))


RL_FROM, RL_TO = dt.date(1998, 1, 1), dt.date(1998, 12, 31)


@report("running_ledger", "W2 W3 W4 W7 Q4 R23", sql=f"""
WITH mv AS (
  SELECT l_partkey, l_orderkey, l_linenumber, {SQL_SIGNED} AS amount
  FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '{RL_FROM}' AND DATE '{RL_TO}'),
op AS (SELECT l_partkey, SUM({SQL_SIGNED}) AS opening FROM lineitem
       WHERE CAST(l_shipdate AS DATE) < DATE '{RL_FROM}' GROUP BY l_partkey),
w AS (
  SELECT mv.*, COALESCE(opening, 0) AS opening,
         SUM(amount) OVER (PARTITION BY mv.l_partkey ORDER BY l_orderkey) AS running,
         SUM(amount) OVER (PARTITION BY mv.l_partkey) AS account_total,
         rank() OVER (PARTITION BY mv.l_partkey ORDER BY l_orderkey) AS doc_rank
  FROM mv LEFT JOIN op ON mv.l_partkey = op.l_partkey)
SELECT l_partkey, l_orderkey, l_linenumber, CAST(amount AS DOUBLE) AS amount, CAST(running AS DOUBLE) AS running,
       CAST(account_total AS DOUBLE) AS account_total, doc_rank, CAST(opening AS DOUBLE) AS opening,
       CAST(opening + running AS DOUBLE) AS year_running,
       CAST(SUM(CASE WHEN doc_rank = 1 THEN opening + amount ELSE amount END)
              OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS DOUBLE) AS year_running_rank
FROM w
""")
def running_ledger(spark, root, start=RL_FROM, end=RL_TO):
    """General ledger lines per account in document order: running balance where lines of one
    document share a value (RANGE frame), account total, document rank, opening balance
    added once (``year_running``) and, for fidelity, once per line of the first document
    (``year_running_rank``)."""
    li = Tables(spark, root).lineitem
    d = as_date("l_shipdate")
    mv = li.where(d.between(F.lit(start), F.lit(end))).select(
        "l_partkey", "l_orderkey", "l_linenumber", signed_amount().alias("amount"))
    by, order = ["l_partkey"], ["l_orderkey"]
    c = scan.chunk_by_range(mv, by, order)
    peers = F.count(F.lit(1)).over(Window.partitionBy(scan.CHUNK, "l_partkey", "l_orderkey"))  # one chunk holds all peers
    c = scan.scan_all(c.withColumn("_peers", peers), by, order, [
        ("running", "sum", F.col("amount"), "range"), ("_upto", "sum", F.lit(1), "range"),
        ("account_total", "total", F.col("amount")), ("_first_doc_lines", "first", F.col("_peers"))])
    c = c.withColumn("doc_rank", (F.col("_upto") - F.col("_peers") + 1).cast("int")).drop("_upto", "_peers", scan.CHUNK)
    op = li.where(d < F.lit(start)).groupBy("l_partkey").agg(F.sum(signed_amount()).alias("opening"))
    j = join_per_key(c, op, by, "left").withColumn("opening", F.coalesce("opening", F.lit(0)))
    return j.select(
        "l_partkey", "l_orderkey", "l_linenumber", F.col("amount").cast("double").alias("amount"),
        F.col("running").cast("double").alias("running"), F.col("account_total").cast("double").alias("account_total"),
        F.col("doc_rank").cast("long").alias("doc_rank"), F.col("opening").cast("double").alias("opening"),
        (F.col("opening") + F.col("running")).cast("double").alias("year_running"),
        (F.col("running") + F.col("opening") * F.col("_first_doc_lines")).cast("double").alias("year_running_rank"))


def _side_sql(side: str) -> str:
    return f"""
WITH s AS (
  SELECT l_suppkey, o_orderkey, year(o_orderdate) AS yr, month(o_orderdate) AS mon,
         SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS amt
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_returnflag {'=' if side == 'credit' else '<>'} 'R' AND l_extendedprice <> 0
  GROUP BY l_suppkey, o_orderkey, year(o_orderdate), month(o_orderdate))
SELECT l_suppkey, o_orderkey, yr, mon, CAST(amt AS DOUBLE) AS {side},
       CAST(SUM(amt) OVER (PARTITION BY l_suppkey ORDER BY yr, mon, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running
FROM s
"""


@report("side_running", "W5 A1 E10 P14 R08", sql=_side_sql("debit"))
def side_running(spark, root):
    """Debit side of each account (supplier): non-zero debit lines summed per entry, with a
    running total over the account by year, month and entry."""
    return _side(spark, root, "debit")


@report("credit_side_running", "W5 A1 E10 P14 R08", sql=_side_sql("credit"))
def credit_side_running(spark, root):
    """Credit side of each account (supplier), as ``side_running``."""
    return _side(spark, root, "credit")


def _side(spark, root, side: str):
    t = Tables(spark, root)
    credit = F.col("l_returnflag") == "R"
    li = t.lineitem.where((credit if side == "credit" else ~credit) & (F.col("l_extendedprice") != 0))
    s = (li.join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
           .groupBy("l_suppkey", "o_orderkey", F.year("o_orderdate").alias("yr"), F.month("o_orderdate").alias("mon"))
           .agg(F.sum(dec("l_extendedprice")).alias(side)))
    order = ["yr", "mon", "o_orderkey"]
    c = scan.cumsum(scan.chunk_by_range(s, ["l_suppkey"], order), F.col(side), ["l_suppkey"], order, "running")
    return c.select("l_suppkey", "o_orderkey", "yr", "mon", F.col(side).cast("double").alias(side),
                    F.col("running").cast("double").alias("running"))


@report("balance_intervals", "S3 J9 W1 E10", sql=f"""
WITH mv AS (SELECT l_partkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS m, SUM({SQL_SIGNED}) AS moved
            FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1, 2 HAVING SUM({SQL_SIGNED}) <> 0)
SELECT l_partkey, m AS valid_from, strftime(lead(m) OVER (PARTITION BY l_partkey ORDER BY m), '%Y-%m-%d') AS valid_to,
       CAST(SUM(moved) OVER (PARTITION BY l_partkey ORDER BY m) AS DOUBLE) AS balance
FROM mv
""")
def balance_intervals(spark, root):
    """Balance of every account as intervals of months in which it stays the same: one row for
    each month with a movement, where the month spine has every account in every month.
    ``valid_to`` is the date as text, NULL for the balance that still holds."""
    i = intervals.balance_intervals(Tables(spark, root).lineitem, ["l_partkey"], as_date("l_shipdate"), signed_amount())
    return i.select("l_partkey", "valid_from", F.col("valid_to").cast("string").alias("valid_to"),
                    F.col("balance").cast("double").alias("balance"))


QUARTER_ENDS = tuple(dt.date(y, m, 1) for y in (1996, 1997, 1998, 1999) for m in (3, 6, 9, 12))


@report("balances_at_quarters", "S3 J9 J2 W1 E4 E10", sql=f"""
WITH asked AS (SELECT unnest([{", ".join(f"DATE '{d}'" for d in QUARTER_ENDS)}]) AS month),
mv AS (SELECT l_partkey, date_trunc('month', l_shipdate) AS m, SUM({SQL_SIGNED}) AS moved FROM lineitem GROUP BY 1, 2)
SELECT p_partkey, month, CAST(COALESCE(SUM(moved) FILTER (WHERE m <= month), 0) AS DOUBLE) AS balance
FROM part CROSS JOIN asked LEFT JOIN mv ON l_partkey = p_partkey GROUP BY 1, 2
""")
def balances_at_quarters(spark, root, months=QUARTER_ENDS):
    """Balance of every account, with or without movements, at the end of the months asked for:
    intervals expanded only there, without a spine of all months and without a range join."""
    t = Tables(spark, root)
    li = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_shipdate", "l_extendedprice", "l_returnflag")
    li = li.join(t.part.select("p_partkey"), "p_partkey", "left_semi")
    i = intervals.balance_intervals(li, ["p_partkey"], as_date("l_shipdate"), signed_amount(), every=t.part)
    b = intervals.balances_at(i, months)
    return b.select("p_partkey", "month", F.col("balance").cast("double").alias("balance"))



LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
              "l_tax", "l_returnflag", "l_shipdate"]


@report("numbered_lines", "W6 E15 A6 R46", sql=f"""
SELECT l_orderkey, l_partkey, l_quantity,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) AS line_no,
       count(*) OVER (PARTITION BY l_orderkey) AS n_lines,
       'Bulto ' || CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) AS VARCHAR)
         || ' de ' || CAST(count(*) OVER (PARTITION BY l_orderkey) AS VARCHAR) AS label
FROM lineitem
""")
def numbered_lines(spark, root):
    """Packing-list numbering: each line numbered within its document under a full
    tie-break, with the document's line count in a label."""
    li = Tables(spark, root).lineitem.select("l_orderkey", *LINE_ORDER)
    j = scan.scan_all(scan.chunk_by_range(li, ["l_orderkey"], LINE_ORDER), ["l_orderkey"], LINE_ORDER,
                      [("line_no", "sum", F.lit(1)), ("n_lines", "total", F.lit(1))])
    return j.select("l_orderkey", "l_partkey", "l_quantity", F.col("line_no").cast("long").alias("line_no"), "n_lines",
                    F.concat(F.lit("Bulto "), F.col("line_no").cast("string"), F.lit(" de "),
                             F.col("n_lines").cast("string")).alias("label"))


@report("control_break_runs", "B1 B2 B5 Q6", sql="""
WITH o AS (
  SELECT o_orderkey, o_orderdate, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS amt,
         CASE WHEN lag(o_orderstatus) OVER (ORDER BY o_orderdate, o_orderkey) IS NOT DISTINCT FROM o_orderstatus
              THEN 0 ELSE 1 END AS brk
  FROM orders),
r AS (SELECT *, SUM(brk) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS run_id FROM o)
SELECT o_orderkey, o_orderstatus, run_id,
       count(*) OVER (PARTITION BY run_id) AS run_rows,
       CAST(SUM(amt) OVER (PARTITION BY run_id) AS DOUBLE) AS run_total,
       CAST(SUM(amt) OVER (PARTITION BY run_id ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_in_run
FROM r
""")
def control_break_runs(spark, root):
    """Control-break groups over documents in date order: a new group starts whenever the
    state differs from the previous document (so one state forms many groups). Each row
    gets its group number, the group's size and total (shown before the group ends) and the
    running total inside the group.

    One pass: runs, totals and running sums come from the same windows and one summary."""
    o = Tables(spark, root).orders.select("o_orderkey", "o_orderdate", "o_orderstatus", dec("o_totalprice").alias("amt"))
    r = nested_breaks(o, [Level("run", F.col("o_orderstatus"), running=True)], ["o_orderdate", "o_orderkey"], [("total", F.col("amt"))])
    return r.select("o_orderkey", "o_orderstatus", F.col("run_run").alias("run_id"), "run_rows",
                    F.col("run_total").cast("double").alias("run_total"),
                    F.col("run_total_running").cast("double").alias("running_in_run"))


_NEST_KEYS = {"anio": "year(o_orderdate)", "mes": "month(o_orderdate)", "estado": "o_orderstatus", "diario": "o_orderpriority"}


def _nested_sql() -> str:
    """Breaks level by level: a level starts where it or any level outside it differs."""
    names, order = list(_NEST_KEYS), "ORDER BY o_orderdate, o_orderkey"
    same = [f"lag({n}) OVER ({order}) IS NOT DISTINCT FROM {n}" for n in names]
    first = f"lag(o_orderkey) OVER ({order}) IS NULL"
    brk = [f"CASE WHEN {first} OR NOT ({' AND '.join(same[:i + 1])}) THEN 1 ELSE 0 END AS b_{n}" for i, n in enumerate(names)]
    run = [f"CAST(SUM(b_{n}) OVER ({order} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS {n}_run" for n in names]
    cols = [c for n in names for c in (
        f"{n}_run", f"count(*) OVER (PARTITION BY {n}_run) AS {n}_rows",
        f"CAST(SUM(amt) OVER (PARTITION BY {n}_run) AS DOUBLE) AS {n}_total")]
    start = " ".join(f"WHEN b_{n} = 1 THEN {i + 1}" for i, n in enumerate(names))
    return f"""
WITH k AS (SELECT o_orderkey, o_orderdate, CAST(o_totalprice AS DECIMAL(18,2)) AS amt,
                  {", ".join(f"{e} AS {n}" for n, e in _NEST_KEYS.items())} FROM orders),
b AS (SELECT *, {", ".join(brk)} FROM k),
r AS (SELECT *, {", ".join(run)} FROM b)
SELECT o_orderkey, CASE {start} ELSE 0 END AS starts, {", ".join(cols)} FROM r
"""


@report("nested_groups", "B1 B2 B5 B7 Q6", sql=_nested_sql())
def nested_groups(spark, root):
    """Documents in date order under four nested report groups (year, month, state, journal
    kind): each document with the run, row count and total of its group on every level, and the
    outermost group that starts at it (1 year ... 4 journal kind, 0 none). A new outer group
    breaks the inner ones; states and journal kinds come back and form new groups each time."""
    o = Tables(spark, root).orders.select(
        "o_orderkey", "o_orderdate", dec("o_totalprice").alias("amt"),
        *[F.expr(e).alias(n) for n, e in _NEST_KEYS.items()])
    g = nested_breaks(o, [(n, F.col(n)) for n in _NEST_KEYS], ["o_orderdate", "o_orderkey"], [("total", F.col("amt"))])
    cols = [c for n in _NEST_KEYS for c in (f"{n}_run", f"{n}_rows", F.col(f"{n}_total").cast("double").alias(f"{n}_total"))]
    return g.select("o_orderkey", "starts", *cols)


OPENING = "100.00"


@report("resettable_running", "B8 B10 Q12", sql=f"""
WITH e AS (SELECT event_id, user_id, ts,
                  CASE WHEN event_type = 'error' THEN 0 ELSE CAST(value AS DECIMAL(18,2)) END AS x FROM events),
f AS (SELECT *, lag(x) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_x FROM e),
g AS (SELECT *, SUM(CASE WHEN COALESCE(prev_x, 0) = 0 THEN 1 ELSE 0 END)
                  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT event_id, user_id, CAST(x AS DOUBLE) AS x, CAST(prev_x AS DOUBLE) AS prev_x,
       CAST(SUM(x) OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id
                         ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS mtd,
       CAST({OPENING} + SUM(x) OVER (PARTITION BY user_id, island ORDER BY ts, event_id
                                    ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS acc
FROM g
""")
def resettable_running(spark, root, opening=OPENING):
    """Accumulator variables per user in time order: previous movement, month-to-date sum,
    and a balance that restarts at ``opening + x`` whenever the previous movement is 0 or
    absent (else previous balance + x)."""
    e = Tables(spark, root).events.select(
        "event_id", "user_id", "ts",
        F.when(F.col("event_type") == "error", F.lit(0).cast("decimal(18,2)")).otherwise(dec("value")).alias("x"),
        F.trunc(as_date("ts"), "MM").alias("month"))
    # One pass: the user's rows, the months in them, and the stretches between two restarts.
    levels = [Level("user", F.col("user_id"), totals=False),
              Level("mon", F.col("month"), inside=["user"], running=True, totals=False),
              Level("acc", after=F.coalesce(F.col("x"), F.lit(0)) == 0, inside=["user"], running=True, totals=False)]
    c = nested_breaks(e, levels, ["user_id", "ts", "event_id"], [("x", F.col("x"))], [("prev_x", F.col("x"), "user")])
    return c.select("event_id", "user_id", F.col("x").cast("double").alias("x"), F.col("prev_x").cast("double").alias("prev_x"),
                    F.col("mon_x_running").cast("double").alias("mtd"),
                    (F.lit(opening).cast("decimal(18,2)") + F.col("acc_x_running")).cast("double").alias("acc"))


SEED = "1000.00"


@report("break_chain_totals", "B11 B12 B15 B1", sql=f"""
WITH e AS (SELECT user_id, ts, event_id, event_type, CAST(value AS DECIMAL(18,2)) AS v,
                  CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT DISTINCT FROM event_type
                       THEN 0 ELSE 1 END AS brk FROM events),
r AS (SELECT *, SUM(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run_id FROM e),
runs AS (SELECT user_id, run_id, max(v) AS run_max, SUM(v) AS run_sum FROM r GROUP BY user_id, run_id)
SELECT user_id, count(*) AS n_runs, CAST(SUM(run_max) AS DOUBLE) AS sum_of_run_max,
       CAST({SEED} + SUM(run_sum) AS DOUBLE) AS seeded_total,
       CAST({SEED} + SUM(run_sum) - SUM(run_max) AS DOUBLE) AS combined
FROM runs GROUP BY user_id
""")
def break_chain_totals(spark, root, seed=SEED):
    """Per user: runs of equal event type in time order; a total that takes one value per run
    (its maximum), a seeded never-reset sum, and their combination."""
    e = Tables(spark, root).events.select("user_id", "ts", "event_id", "event_type", dec("value").alias("v"))
    r = with_breaks(e, ["event_type"], ["ts", "event_id"], by=["user_id"])
    runs = r.groupBy("user_id", "run_id").agg(F.max("v").alias("run_max"), F.sum("v").alias("run_sum"))
    s = F.lit(seed).cast("decimal(18,2)")
    g = runs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("run_max").alias("m"), F.sum("run_sum").alias("t"))
    return g.select("user_id", "n_runs", F.col("m").cast("double").alias("sum_of_run_max"),
                    (s + F.col("t")).cast("double").alias("seeded_total"),
                    (s + F.col("t") - F.col("m")).cast("double").alias("combined"))
