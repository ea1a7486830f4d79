"""Registered queries: each pairs an operator call on the given tables with an equivalent SQL text."""

from . import (  # noqa: F401  (imports register the queries)
    q_aggregates,
    q_assets,
    q_extract,
    q_filters,
    q_graph,
    q_joins,
    q_parse,
    q_quality,
    q_ranking,
    q_search,
    q_similarity,
    q_sources,
    q_streaming,
)
from .registry import ORACLES, QUERIES  # noqa: F401
