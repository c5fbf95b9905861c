"""Load over time: hourly counts, capacity quantile and the worst contiguous window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hourly_counts(df: DataFrame, minutes: str, n_hours: int) -> DataFrame:
    """(hour, n) for hours 1..n_hours, zero where nothing fell; minutes, fractions too, outside of them are left out."""
    seen = df.where((F.col(minutes) >= 0) & (F.col(minutes) < n_hours * 60)).groupBy((F.floor(F.col(minutes) / 60) + 1).alias("hour")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(1, n_hours + 1).withColumnRenamed("id", "hour")
    return spine.join(seen, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def load_by_hour(df: DataFrame, ts: str) -> DataFrame:
    """(hour timestamp, n) from the first to the last hour of the data, zero-filled."""
    hour = F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz")
    seen = df.where(F.col(ts).isNotNull()).groupBy(hour.alias("hour")).agg(F.count("*").alias("n"))
    span = seen.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi")).where("lo is not null")
    spine = span.select(F.explode(F.expr("sequence(lo, hi, interval 1 hour)")).alias("hour"))
    return spine.join(seen, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def max_subarray(df: DataFrame, order: str, value: Column) -> DataFrame:
    """(best, first, last): the contiguous run of rows, at least one, with the greatest sum; the earliest end on ties, then the shortest.

    One row for each hour or the like, so the windows run over a spine whose size is the time span, not the data.
    """
    p = df.select(F.col(order).alias("at"), value.cast("double").alias("x")).withColumn("p", F.sum("x").over(Window.orderBy("at")))
    before = p.withColumn("q", F.coalesce(F.lag("p").over(Window.orderBy("at")), F.lit(0.0)))
    lows = before.withColumn("low", F.max(F.struct((-F.col("q")).alias("q"), F.col("at").alias("since"))).over(Window.orderBy("at")))
    best = lows.select((F.col("p") + F.col("low.q")).alias("best"), F.col("low.since").alias("first"), F.col("at").alias("last"))
    return best.orderBy(F.desc("best"), "last").limit(1)
