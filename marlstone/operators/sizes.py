"""The planner's size estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame


def planned_bytes(df: DataFrame) -> int | None:
    """Bytes that the planner expects of a DataFrame, from file sizes; None where it does not know. No job runs."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else None
