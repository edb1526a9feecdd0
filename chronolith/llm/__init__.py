"""Operators of training-data pipelines.  Nothing else in the library imports this subpackage."""

from chronolith.llm import queries  # noqa: F401 - importing registers the queries
from chronolith.llm.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
