"""All queries of the library but those for training data."""

from __future__ import annotations

from tracemill.jobs import documents, eventlog, files, graphs, ledger, lookups, records, reports, retrieval, state

MODULES = (ledger, eventlog, records, retrieval, graphs, files, state, documents, lookups, reports)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
