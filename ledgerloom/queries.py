"""Registered queries of the document engine."""

from __future__ import annotations

from .plans import changing, indexed, intake, invoices, lookups, relational, rules, scanned, text_plans, totals  # noqa: F401  they register on import
from .plans.registry import PLANS, Plan


def queries() -> dict[str, Plan]:
    return {name: fn for name, (fn, _) in PLANS.items()}
