"""All registered queries."""

from __future__ import annotations

from contigua.plans import builder_queries, caller_queries, format_queries, graph_queries, index_queries, layout_queries, read_queries, realign_queries, stat_queries  # noqa: F401
from contigua.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
