"""Named queries with an optional independent SQL check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from emberline.fixtures import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    key: str
    run: QueryFn
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(key: str, sql: str | None = None, views: str = "") -> Callable[[QueryFn], QueryFn]:
    """Register a query; ``views`` lists the fixture views its SQL reads."""
    def register(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = Query(key, fn, with_views(sql, *views.split()) if sql else None)
        return fn
    return register


def great_circle(lat1: str, lon1: str, lat2: str, lon2: str, radius: str = "6371008.8e0") -> str:
    """Haversine as SQL text, for checks."""
    return (f"2e0*{radius}*asin(sqrt(least(1e0, pow(sin(radians({lat2}-{lat1})/2e0),2) + "
            f"cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians({lon2}-{lon1})/2e0),2))))")


def load_all() -> dict[str, Query]:
    from emberline.plans import (queries_alerts, queries_clean, queries_clusters, queries_learning,  # noqa: F401
                                 queries_reports, queries_scoring, queries_sources, queries_spatial, queries_streaming)
    return QUERIES
