"""All registered queries of the item-response part."""

from __future__ import annotations

from latentia.plans import curves, estimates, queries, spaces, statistics

MODULES = (queries, curves, statistics, estimates, spaces)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
