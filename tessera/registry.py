"""The queries of the engine's own operators, and the SQL they are checked against."""

from tessera.plans import behaviour, corpus, evaluation, metrics, relational, retrieval, scheduling, sessions  # noqa: F401
from tessera.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
