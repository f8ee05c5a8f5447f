"""Registered queries: every operator on panels derived from the warehouse tables,
with the equivalent SQL where plain SQL can express it."""

from gearwatch.catalog.base import QUERIES, SQL
from gearwatch.catalog import (  # noqa: F401  (importing registers the queries)
    anomaly,
    history,
    labels,
    learning,
    metrics,
    quality,
    serving,
    stored,
    suites,
)

__all__ = ["QUERIES", "SQL"]
