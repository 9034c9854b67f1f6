"""Registered queries over the given tables, each with its oracle SQL."""

from specweave.queries import checking, judging, matching, specs, upkeep, whole  # noqa: F401
from specweave.queries.registry import REGISTRY

__all__ = ["REGISTRY"]
