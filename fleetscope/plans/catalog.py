"""Import every query module so that the registry is complete."""

from __future__ import annotations

from . import (  # noqa: F401
    q_aggs, q_alerts, q_catalog, q_catalog_rest, q_checks, q_dims, q_events, q_graph, q_ingest, q_joins, q_metrics, q_misc,
    q_more, q_rates,
    q_report, q_report_views, q_space,
    q_surface,
    q_text,
    q_time,
)
from .registry import REGISTRY

__all__ = ["REGISTRY"]
