"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from tracewell.plans import core_queries, graph_queries, merge_queries, reader_queries, root_queries, rule_queries, stream_queries, text_queries

_MODULES = (core_queries, graph_queries, rule_queries, root_queries, merge_queries, stream_queries, text_queries, reader_queries)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
