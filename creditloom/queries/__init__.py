"""Registered queries: each a Spark plan, most with the same result in SQL."""

from __future__ import annotations

from creditloom.queries import registry
from creditloom.queries import (  # noqa: F401  (importing fills the registry)
    binning,
    evaluation,
    loss,
    models,
    preparation,
    sources,
    text,
)

queries = registry.queries
oracle_sql = registry.oracle_sql
