"""All registered queries of the library proper, and their SQL."""

from __future__ import annotations

from changeloom.plans import change_queries, compare_queries, file_queries, history_queries, ledger_queries

_PARTS = (history_queries, ledger_queries, compare_queries, change_queries, file_queries)
QUERIES = {name: run for part in _PARTS for name, run in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
