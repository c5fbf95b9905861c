"""Spatial joins on grid buckets, nearest nodes, and convex hulls as a two-step aggregate."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .rounds import Rounds

#: Coordinates of segments are rounded to so many places before they are compared, as the reference values assume.
SNAP = 6


def _pieces(segments: DataFrame, wide: float, high: float) -> DataFrame:
    """``segments`` once for each grid cell that their line may pass: in every column of cells the rows that it spans there."""
    low, top = F.least("x1", "x2"), F.greatest("x1", "x2")
    slope = F.when(F.col("x1") != F.col("x2"), (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1")))
    cut = segments.withColumn("cx", F.explode(F.sequence(F.floor(low / wide), F.floor(top / wide))))
    at = lambda x: F.col("y1") + slope * (x - F.col("x1"))
    left, right = at(F.greatest(low, F.col("cx") * wide)), at(F.least(top, (F.col("cx") + 1) * wide))
    a, b = F.coalesce(left, F.col("y1")), F.coalesce(right, F.col("y2"))
    margin = 1e-6
    return cut.withColumn("cy", F.explode(F.sequence(F.floor((F.least(a, b) - margin) / high), F.floor((F.greatest(a, b) + margin) / high))))


def crossings(segments: DataFrame, cell: tuple[float, float] | None = None) -> DataFrame:
    """(a, b, x, y): pairs a < b of intersecting segments(id, g, x1, y1, x2, y2) of different g, and where they meet.

    Coordinates are snapped to a 1e-6 grid. Parallel segments that touch meet at an end that both have. Segments meet in
    the grid cells that their lines pass; a cell's sides are twice the mean extents along either axis unless ``cell`` is
    given, so that a segment passes a few cells however either axis is scaled.
    """
    ends = ["x1", "y1", "x2", "y2"]
    rows = segments.select("id", "g", *[F.round(c, SNAP).alias(c) for c in ends])
    if cell is None:
        wide, high = (2 * (x or 0) for x in rows.agg(F.avg(F.abs(F.col("x2") - F.col("x1"))), F.avg(F.abs(F.col("y2") - F.col("y1")))).first())
        cell = wide or high or 1.0, high or wide or 1.0
    cut = _pieces(rows, *cell)
    side = lambda p: cut.select(*[F.col(c).alias(p + c) for c in ("id", "g", *ends)], "cx", "cy")
    of = lambda p: [F.col(p + c) for c in ends]
    met = side("a_").join(side("b_"), ["cx", "cy"]).where("a_id < b_id and a_g <> b_g").where(g.segments_intersect(of("a_"), of("b_"))).drop("cx", "cy").distinct()
    point = F.coalesce(g.intersection_point(of("a_"), of("b_")), g.shared_end(of("a_"), of("b_")))
    return met.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), point.alias("p")).select("a", "b", "p.x", "p.y")


def nearest_nodes(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, node, square): the nearest of nodes(id, x, y) to each of points(id, x, y) by the square of the distance, the
    smallest id on ties; no row for points without coordinates or where there are no nodes.

    A point looks into its cell and the eight around it. What it finds nearer than a cell's side is the answer; the points
    that are left look again with cells of four times the side, until the nine hold all nodes.
    """
    rounds = Rounds(points.sparkSession)
    places = nodes.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null")
    places = rounds.keep(places.groupBy("x", "y").agg(F.min("id").alias("node")))
    open_ = rounds.keep(points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null"))
    span = lambda t: t.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    have, ask = span(places), span(open_)
    if not have[4] or not ask[4]:
        return open_.select("id", F.lit(None).cast(places.schema["node"].dataType).alias("node"), F.lit(0.0).alias("square")).limit(0)
    whole = max(max(have[1], ask[1]) - min(have[0], ask[0]), max(have[3], ask[3]) - min(have[2], ask[2]))
    area = (have[1] - have[0]) * (have[3] - have[2])
    cell = math.sqrt(2 * area / have[4]) or whole / have[4] or 1.0
    cell = max(cell, whole / 2**40) or 1.0
    found: DataFrame | None = None
    while True:
        last = cell >= whole
        at = lambda c, k=0: F.floor(F.col(c) / cell) + k
        around = F.array(*[F.struct(at("x", i).alias("cx"), at("y", j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        near = open_.select("id", "x", "y", F.explode(around).alias("c")).select("id", "x", "y", "c.*")
        held = places.select("node", F.col("x").alias("nx"), F.col("y").alias("ny"), at("x").alias("cx"), at("y").alias("cy"))
        square = (F.col("x") - F.col("nx")) * (F.col("x") - F.col("nx")) + (F.col("y") - F.col("ny")) * (F.col("y") - F.col("ny"))
        best = near.join(held, ["cx", "cy"]).groupBy("id", "x", "y").agg(F.min(F.struct(square.alias("square"), F.col("node"))).alias("m"))
        best = rounds.keep(best.select("id", "x", "y", "m.*"))
        sure = best if last else best.where(F.col("square") < cell * cell)
        own = sure.select("id", "node", "square")
        found = own if found is None else found.union(own)
        if last:
            return found
        rest = rounds.keep(open_.join(sure.select("id", "x", "y"), ["id", "x", "y"], "left_anti"))
        if rest.isEmpty():
            return found
        open_, cell = rest, cell * 4


def inside_polygons(points: DataFrame, corners: DataFrame, polygon: str = "polygon") -> DataFrame:
    """(id, polygon, inside) for each of points(id, x, y) and each convex polygon of corners(polygon, rank, x, y), which go
    counter-clockwise: on the left of every side or on it. One corner holds points equal to it only.

    The polygons are an instance, not a fact table: their corners ride with each point's row.
    """
    ring = corners.groupBy(polygon).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "x", "y"))), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))).alias("ring"))
    return points.crossJoin(F.broadcast(ring)).select("id", polygon, inside_ring(F.col("x"), F.col("y"), F.col("ring")).alias("inside"))


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether (x, y) is in a convex ring, an array of struct<x, y> counter-clockwise; an empty one holds nothing."""
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring), F.lit(1))), F.slice(ring, 1, 1))
    left = F.forall(F.zip_with(ring, turned, lambda a, b: (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]) >= -g.EPS), lambda ok: ok)
    return F.when(F.size(ring) == 0, False).when(F.size(ring) == 1, (x == ring[0]["x"]) & (y == ring[0]["y"])).otherwise(left)


def hull(points: list[tuple]) -> list[tuple]:
    """Strict hull vertices (x, y, ...) counter-clockwise from the lowest, then leftmost; collinear and equal points go."""
    ordered = sorted({(p[0], p[1]): p for p in sorted(points, reverse=True)}.values())
    if len(ordered) < 3:
        return sorted(ordered, key=lambda p: (p[1], p[0]))

    def chain(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= g.EPS:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = chain(ordered) + chain(ordered[::-1])
    start = min(range(len(ring)), key=lambda i: (ring[i][1], ring[i][0]))
    return ring[start:] + ring[:start]


def convex_hulls(points: DataFrame, group: str, key: str, x: str, y: str) -> DataFrame:
    """(group, key, x, y, rank): each group's hull in order. Hulls of parts come first, so a large group leaves few rows."""
    rows = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def partial(batches):
        for pdf in batches:
            for name, own in pdf.groupby("g", sort=False):
                ring = hull(list(zip(own["x"], own["y"], own["k"], strict=True)))
                yield pd.DataFrame({"g": name, "k": [p[2] for p in ring], "x": [p[0] for p in ring], "y": [p[1] for p in ring]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = hull(list(zip(pdf["x"], pdf["y"], pdf["k"], strict=True)))
        return pd.DataFrame({"g": pdf["g"].iloc[0], "k": [p[2] for p in ring], "x": [p[0] for p in ring], "y": [p[1] for p in ring], "rank": range(1, len(ring) + 1)})

    shape = f"g {kinds['g']}, k {kinds['k']}, x double, y double"
    out = rows.mapInPandas(partial, shape).groupBy("g").applyInPandas(whole, shape + ", rank long")
    return out.select(F.col("g").alias(group), F.col("k").alias(key), "x", "y", "rank")


def polygon_area(rings: DataFrame, group: str) -> DataFrame:
    """(group, area) of rings(group, x, y, rank): shoelace over ordered corners, 0 below three."""
    ring = rings.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("rank", "x", "y"))).alias("p"))
    turned = F.concat(F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))), F.slice("p", 1, 1))
    twice = F.aggregate(F.zip_with("p", turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)
    return ring.select(group, F.when(F.size("p") < 3, 0.0).otherwise(F.abs(twice) / 2).alias("area"))
