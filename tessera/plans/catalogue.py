"""All queries over the driver's tables, and their SQL counterparts."""

from __future__ import annotations

from . import assessments, governance, labelling, linking, models, projections, receipts, reviews, rollups, texts

_MODULES = (rollups, texts, linking, governance, reviews, assessments, labelling, receipts, projections, models)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
