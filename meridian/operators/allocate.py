"""Allocation: rankings, and knapsacks by running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running_sum


def fractional_knapsack(items: DataFrame, key: str, value: str, weight: str, capacity: float | Column) -> DataFrame:
    """(key, value, weight, fraction): filled by falling density, ties by key; items without positive weight are left out."""
    room = capacity if isinstance(capacity, Column) else F.lit(float(capacity))
    rows = items.where(F.col(weight) > 0).withColumns({"_density": F.col(value) / F.col(weight), "_w": F.col(weight).cast("double")})
    run = running_sum(rows, ["_density", key], "_w", "_before", descending=True)
    return run.withColumn("fraction", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (room - F.col("_before")) / F.col(weight)))).drop("_density", "_w", "_before")


def urgent_first(incidents: DataFrame, key: str, severity: str, demand: str, k: int) -> DataFrame:
    """The k rows of greatest severity * 1000 + demand, ties by key."""
    return incidents.withColumn("urgency", F.col(severity) * 1000 + F.col(demand)).orderBy(F.desc("urgency"), key).limit(k)


def urgent_in_window(incidents: DataFrame, key: str, minute: str, since: float, until: float, severity: str, demand: str, k: int) -> DataFrame:
    """``urgent_first`` of the rows with since <= minute < until."""
    return urgent_first(incidents.where((F.col(minute) >= since) & (F.col(minute) < until)), key, severity, demand, k)
