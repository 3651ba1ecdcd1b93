"""All registered queries and their DuckDB oracles."""

from . import catalogue_queries, motion_queries, order_queries, relational_queries, scale_queries, stat_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
