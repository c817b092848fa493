"""All registered queries."""

from tallybook.plans import (  # noqa: F401
    classify_queries,
    fault_queries,
    ingest_queries,
    report_queries,
)
from tallybook.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
