"""All queries of the library outside the training-text package, with their SQL."""

from __future__ import annotations

from lectern.plans import feature_queries, graph_queries, orphan_queries, report_queries, scoring_queries, stream_queries

FLAGSHIP = "scorecards"
_MODULES = (orphan_queries, scoring_queries, feature_queries, graph_queries, stream_queries, report_queries)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
