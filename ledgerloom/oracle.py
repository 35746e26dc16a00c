"""DuckDB statements for the registered queries."""

from __future__ import annotations

from . import queries as _registered  # noqa: F401  registers the plans
from .plans.registry import PLANS


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in PLANS.items() if sql}
