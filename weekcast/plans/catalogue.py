"""All registered queries."""

from weekcast.plans import (  # noqa: F401
    queries_compare,
    queries_forecast,
    queries_ingest,
    queries_news,
    queries_ops,
    queries_store,
)
from weekcast.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
