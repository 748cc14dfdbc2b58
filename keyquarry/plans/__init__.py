"""Every named query, and the SQL that states its result where SQL can."""

from keyquarry.plans import access, flows, scanning, search, streams, usage, vault  # noqa: F401
from keyquarry.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
