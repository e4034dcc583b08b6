"""Registry of the queries outside the optional subpackage."""

from kgspark.plans import fetching, graph, grouping, ingest, lookups, quality, records, retrieval, streams, text, workflows  # noqa: F401
from kgspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
