"""All registered queries with their DuckDB SQL."""

from __future__ import annotations

from nearfield.plans import relational, scalar, streams  # noqa: F401
from nearfield.plans.registry import QUERIES, SQL

FLAGSHIP = "knn_tiled"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
