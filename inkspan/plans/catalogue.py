"""All registered queries."""

from . import fitted, measures, models, panels, structure  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
