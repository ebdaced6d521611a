"""Session settings the plans of this package are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Timestamps are stored without a zone; pin the zone so nothing shifts.
    "spark.sql.session.timeZone": "UTC",
    # Joins carry no broadcast hint: the engine picks a broadcast when the
    # measured side is small and splits skewed partitions when it is not. File
    # sizes are compressed, so before any measurement only 1 MB counts as small.
    "spark.sql.autoBroadcastJoinThreshold": "1MB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    # Hash instead of sort where every measured partition of one side fits.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(
    app_name: str = "caseflow",
    master: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create or reuse a session. On a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
