"""All queries of the library."""

from __future__ import annotations

from parcelspark.plans import correspondence, drawings, files, identifiers, listings, lookups, records, shapes, spatial, workflow  # noqa: F401
from parcelspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
