"""Registered queries over the test tables, each with its SQL where SQL can say it."""

from chronolith.catalog.base import QUERIES, SQL
from chronolith.catalog import (  # noqa: F401 - importing registers the queries
    align, calendar, clean, leaderboard, models, plans, probabilistic, sources, stats, windows)

__all__ = ["QUERIES", "SQL"]
