"""All carrier queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from quillon.plans import explorer_carriers, join_carriers, match_carriers, rule_carriers, table_carriers, view_carriers  # noqa: F401  (they register themselves)
from quillon.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
