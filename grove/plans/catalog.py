"""Named queries over the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

from grove.plans import histories, merges, stores, trees, workflows

PARTS = [trees, histories, stores, workflows, merges]
QUERIES = {k: v for p in PARTS for k, v in p.QUERIES.items()}
ORACLES = {k: v for p in PARTS for k, v in p.ORACLES.items()}
