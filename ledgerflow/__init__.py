"""ledgerflow: parameterised ledger, billing and logistics reports on Spark.

Layout
------
sources/    table registry (parquet / jdbc), inline constant relations
functions/  column expressions: money, dates, document numbers, amount in words, decodes
operators/  reusable DataFrame operators: wide pivot, crosstab totals, control breaks,
            running ledgers, ageing, master/detail, reconciliation, total rows
plans/      the report jobs, each registered with its DuckDB oracle SQL
streaming/  (the reports are batch only; see its docstring)
"""

from ledgerflow.session import get_session, ensure_checkpoint_dir

__all__ = ["get_session", "ensure_checkpoint_dir"]
