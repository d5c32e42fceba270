"""Named pipelines and the query catalogue (importing registers all keys)."""

from smolt.plans import (  # noqa: F401
    q_aggs, q_basic, q_joins, q_pipelines, q_reshape, q_scalars, q_sort, q_sources, q_stats,
    q_survival,
    q_windows,
)
from smolt.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
