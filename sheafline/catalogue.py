"""All queries of the library by name, each with its SQL where SQL can state it."""

from __future__ import annotations

from .operators import dedup, documents, elements, folds, grammar, helpers, history, items, layout, obligations, planning, records, render, scans, sections, service, tables  # noqa: F401  they register their queries
from .plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
