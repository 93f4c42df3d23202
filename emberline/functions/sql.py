"""SQL functions: plain SQL bodies that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "haversine_m": ("lat1 double, lon1 double, lat2 double, lon2 double", "double",
                    "2 * 6371008.8D * asin(sqrt(least(1D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) "
                    "* cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"),
    "persistence_score": ("d24 bigint, d7 bigint", "double",
                          "case when d7 = 0 and d24 = 0 then 0D else greatest(0D, least(1D, greatest(least(1D, d7 / 10D * 0.7D "
                          "+ d24 / 5D * 0.3D), (1 - exp(-0.35D * d7)) * 0.8D))) end"),
    "risk_level": ("score int", "string",
                   "case when score >= 75 then 'CRITICAL' when score >= 50 then 'HIGH' when score >= 30 then 'MODERATE' else 'LOW' end"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the session functions; returns their names."""
    for name, (params, kind, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({params}) returns {kind} return {body}")
    return list(FUNCTIONS)
