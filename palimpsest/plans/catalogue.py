"""The registered queries over the driver tables, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.plans import filter_queries, geometry_queries, page_queries, profile_queries, report_queries, sample_queries, sheet_queries, strip_queries, text_queries, tile_queries  # noqa: F401  they register themselves

FLAGSHIP = "eval_grouping_sets"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query."""
    return dict(tile_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return dict(tile_queries.SQL)
