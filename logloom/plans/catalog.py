"""All registered queries."""

from __future__ import annotations

from logloom.plans import (  # noqa: F401  each registers its queries
    access_plans,
    audit_plans,
    cluster_plans,
    codec_plans,
    group_plans,
    maintenance_plans,
    metric_plans,
    offset_plans,
    replication_plans,
    scan_plans,
    schema_plans,
    stream_plans,
    tier_plans,
)
from logloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
