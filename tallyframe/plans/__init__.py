"""Registered queries, grouped by area."""

from tallyframe.plans import (  # noqa: F401
    business,
    cleaning,
    profiling,
    rows,
    series,
    statistics,
    storage,
    targets,
    text,
)
from tallyframe.plans.base import REGISTRY

__all__ = ["REGISTRY"]
