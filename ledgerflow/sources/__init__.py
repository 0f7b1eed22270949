from ledgerflow.sources.tables import Tables, TABLE_NAMES, read_jdbc
from ledgerflow.sources.inline import values, where_in
from ledgerflow.sources.periods import PeriodBalances
from ledgerflow.sources.published import PublishedReport
from ledgerflow.sources.sinks import write_report

__all__ = ["PeriodBalances", "PublishedReport", "Tables", "TABLE_NAMES", "read_jdbc", "values", "where_in", "write_report"]
