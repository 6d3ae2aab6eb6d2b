"""All registered queries and their oracles."""

from visitloom.plans import aggregates, joins, kept, metrics, models, scalars, scans, windows  # noqa: F401
from visitloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
