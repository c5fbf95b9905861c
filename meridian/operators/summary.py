"""Ranges, bins and fits: pairs within a radius, density, quantile bins, log-log slope, cycle cost, unit expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .discs import place_density


def within_radius(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """(a, b, dist): rows of a(id, x, y) and b(id, x, y) at most ``radius`` apart; b visits its cell's nine neighbours, a its own."""
    cell = lambda c: F.floor(F.col(c) / radius)
    left = a.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("cx"), cell("y").alias("cy"))
    around = F.array(*[F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    right = b.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.explode(around).alias("c")).select("b", "bx", "by", "c.*")
    square = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
    return left.join(right, ["cx", "cy"]).where(square <= radius * radius).select("a", "b", F.sqrt(square).alias("dist"))


def coverage_sets(dist: DataFrame, radius: float | Column) -> DataFrame:
    """(station, place) of dist(a, b, dist): what lies within ``radius`` (closed) of a station a, in that direction."""
    return dist.where(F.col("dist") <= radius).select(F.col("a").alias("station"), F.col("b").alias("place"))


def covered(sets: DataFrame, chosen: DataFrame, by: str) -> DataFrame:
    """(by, covered): how many places the stations of chosen(by, station) cover together."""
    return chosen.join(sets, "station").groupBy(by).agg(F.countDistinct("place").alias("covered"))


def watched(links: DataFrame, chosen: DataFrame, by: str) -> DataFrame:
    """(by, watched): how many of links(u, v) have an end among chosen(by, node)."""
    ends = links.select("u", "v", F.explode(F.array_distinct(F.array("u", "v"))).alias("node"))
    return ends.join(chosen, "node").groupBy(by).agg(F.countDistinct("u", "v").alias("watched"))


def sum_over(df: DataFrame, chosen: DataFrame, key: str, value: str) -> DataFrame:
    """(total) of ``value`` over the rows whose ``key`` is among chosen(key), each row once; 0 for none."""
    return df.join(chosen.select(key).distinct(), key, "left_semi").agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))


def medians(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.groupBy(group).agg(F.median(value).alias("median"))


def density(points: DataFrame, radius: float) -> DataFrame:
    """(id, n): how many points lie within the radius of each, itself included; points of the same id are added up."""
    rows = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return rows.join(place_density(rows, radius), ["x", "y"]).groupBy("id").agg(F.sum("n").alias("n"))


def quantile_bins(df: DataFrame, value: str, at: list[float]) -> DataFrame:
    """Adds bin, from 1: half-open between the quantiles, the last one closed. The quantiles are one row."""
    cuts = df.agg(F.percentile(value, F.array(*map(F.lit, at))).alias("cuts"))
    inner = F.aggregate(F.slice("cuts", 2, len(at) - 2), F.lit(1), lambda n, c: n + (F.col(value) >= c).cast("int"))
    return df.crossJoin(F.broadcast(cuts)).withColumn("bin", inner).drop("cuts")


def loglog_slope(df: DataFrame, x: str, y: str) -> DataFrame:
    """(slope) of ln y on ln x; null below three usable points."""
    return df.where((F.col(x) > 0) & (F.col(y) > 0)).agg(F.when(F.count("*") >= 3, F.regr_slope(F.ln(y), F.ln(x))).alias("slope"))


def cycle_cost(stops: DataFrame, dist: DataFrame, tour: str) -> DataFrame:
    """(tour, cost) of stops(tour, place, id) as closed cycles over dist(a, b, dist)."""
    w = Window.partitionBy(tour).orderBy("place")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    legs = stops.select(tour, F.col("id").alias("a"), F.coalesce(F.lead("id").over(w), F.first("id").over(whole)).alias("b"))
    return legs.join(dist, ["a", "b"]).groupBy(tour).agg(F.sum("dist").alias("cost"))


def expand_units(df: DataFrame, units: str, time: str | None = None, limit: float | None = None) -> DataFrame:
    """One row for each unit, with unit from 1; rows without units go, and with ``time`` those beyond ``limit``."""
    if time is not None:
        df = df.where(F.col(time) <= limit)
    return df.where(F.col(units) >= 1).withColumn("unit", F.explode(F.sequence(F.lit(1), F.col(units).cast("int"))))


def spaced_top(candidates: list[tuple], n: int, apart: float) -> list[tuple]:
    """The first n of (score, id, x, y), best first, that keep ``apart`` from each other; for a bounded top list."""
    kept: list[tuple] = []
    for c in sorted(candidates, key=lambda c: (-c[0], c[1])):
        if all((c[2] - k[2]) ** 2 + (c[3] - k[3]) ** 2 >= apart * apart for k in kept):
            kept.append(c)
        if len(kept) == n:
            break
    return kept
