"""All queries of the reference's own operators."""

from quarrykit.plans import column_queries, corpus_queries, lasting_queries  # noqa: F401  they register themselves
from quarrykit.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
