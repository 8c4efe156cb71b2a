"""The queries of the ledger library and the SQL that checks them, by name."""

from __future__ import annotations

from ledgerloom.plans import cases, core, evidence  # noqa: F401  (each adds its queries to those of core)

QUERIES: dict = {**core.QUERIES}
ORACLES: dict = {**core.ORACLES}
