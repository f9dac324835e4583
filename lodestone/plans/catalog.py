"""Names of all registered queries, their functions and their SQL equivalents."""

from __future__ import annotations

from lodestone.plans import graphs, items, ledger, relations, work  # noqa: E402, F401
from lodestone.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

