"""All queries over the engine's own operators and their SQL."""

from sparkann.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
