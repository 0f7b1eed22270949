"""Report jobs. Importing this package registers every job in ``REGISTRY``."""

from ledgerflow.plans.registry import REGISTRY, Report, report  # noqa: F401
from ledgerflow.plans import statements, filters, columns, joins, aggregates, pivots, ledger, documents, financial, books, operations, listings  # noqa: F401
