"""The queries of the core, by name, and SQL to compare them with."""

from __future__ import annotations

from quarry.plans import change_queries, index_queries, search_queries

QUERIES: dict = {**change_queries.QUERIES, **search_queries.QUERIES, **index_queries.QUERIES}
SQL: dict[str, str] = {**change_queries.SQL, **search_queries.SQL, **index_queries.SQL}
FLAGSHIP = "hybrid_search"
