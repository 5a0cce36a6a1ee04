"""Jobs composed of operators, and the registered queries."""

from __future__ import annotations


def all_queries() -> tuple[dict, dict]:
    """All queries by name, and the SQL of those that have it."""
    from . import (  # noqa: F401
        amp_queries, coverage_queries, extraction_queries, fit_queries, frame_queries, join_queries, model_queries, robust_queries, trace_queries, wavelength_queries, window_queries,
    )
    from .registry import QUERIES, SQL

    return QUERIES, SQL
