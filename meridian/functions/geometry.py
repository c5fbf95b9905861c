"""Geometry as Column arithmetic; points are pairs of double columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def local_xy(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Metres east and north of a centre."""
    return (lon - lon0) * 111320.0 * F.cos(F.radians(F.lit(lat0))), (lat - lat0) * 110574.0


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6371000.0) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * radius * F.asin(F.sqrt(h))


def within(lon: Column, lat: Column, lon0: float, lat0: float, r: float) -> Column:
    x, y = local_xy(lon, lat, lon0, lat0)
    return x * x + y * y <= r * r


def orientation(ax, ay, bx, by, cx, cy) -> Column:
    """-1, 0 or 1: on which side of a-b the point c lies."""
    z = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return F.when(z > EPS, 1).when(z < -EPS, -1).otherwise(0)


def on_segment(ax, ay, bx, by, px, py) -> Column:
    """For p collinear with a-b."""
    return px.between(F.least(ax, bx) - EPS, F.greatest(ax, bx) + EPS) & py.between(F.least(ay, by) - EPS, F.greatest(ay, by) + EPS)


def segment_length(ax, ay, bx, by) -> Column:
    return F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))


def segment_angle(ax, ay, bx, by) -> Column:
    return F.atan2(by - ay, bx - ax)


def segments_parallel(a: list[Column], b: list[Column]) -> Column:
    return F.abs((a[2] - a[0]) * (b[3] - b[1]) - (a[3] - a[1]) * (b[2] - b[0])) <= EPS


def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / square))).otherwise(0.0)
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def segments_intersect(a: list[Column], b: list[Column]) -> Column:
    """Closed segments x1, y1, x2, y2; touching and collinear overlap count."""
    o1, o2 = orientation(*a, b[0], b[1]), orientation(*a, b[2], b[3])
    o3, o4 = orientation(*b, a[0], a[1]), orientation(*b, a[2], a[3])
    touch = ((o1 == 0) & on_segment(*a, b[0], b[1])) | ((o2 == 0) & on_segment(*a, b[2], b[3])) | ((o3 == 0) & on_segment(*b, a[0], a[1])) | ((o4 == 0) & on_segment(*b, a[2], a[3]))
    return ((o1 != o2) & (o3 != o4)) | touch


def intersection_point(a: list[Column], b: list[Column]) -> Column:
    """struct<x, y>, null for parallel segments or where the lines meet outside either."""
    dax, day, dbx, dby = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
    den = dax * dby - day * dbx
    t = ((b[0] - a[0]) * dby - (b[1] - a[1]) * dbx) / den
    u = ((b[0] - a[0]) * day - (b[1] - a[1]) * dax) / den
    flat = F.abs(den) <= EPS * (F.abs(dax) + F.abs(day) + 1) * (F.abs(dbx) + F.abs(dby) + 1)
    inside = t.between(-1e-9, 1 + 1e-9) & u.between(-1e-9, 1 + 1e-9)
    return F.when(~flat & inside, F.struct((a[0] + t * dax).alias("x"), (a[1] + t * day).alias("y")))


def shared_end(a: list[Column], b: list[Column]) -> Column:
    """struct<x, y> of an end that both segments have, null if there is none."""
    out = F.lit(None).cast("struct<x: double, y: double>")
    for i in (0, 2):
        for j in (0, 2):
            out = F.when((a[i] == b[j]) & (a[i + 1] == b[j + 1]), F.struct(a[i].alias("x"), a[i + 1].alias("y"))).otherwise(out)
    return out


def grid_zone(x: Column, y: Column, x0, x1, y0, y1, n: int = 3) -> Column:
    cell = lambda v, lo, hi: F.least(F.lit(n), 1 + F.floor(n * (v - lo) / (hi - lo + 1e-9)))
    return (cell(y, y0, y1) - 1) * n + cell(x, x0, x1)


def harmonic(d: Column) -> Column:
    return F.when(d >= 1, F.aggregate(F.sequence(F.lit(1), F.greatest(d, F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + F.lit(1.0) / i)).otherwise(0.0)


def min_cut_trials(n: Column, delta: float) -> Column:
    """Contraction trials for failure below delta."""
    return F.ceil(F.log(F.lit(1.0 / delta)) / (2.0 / (n * (n - 1))))


def min_cut_success(n: Column, trials: Column) -> Column:
    return 1 - F.pow(1 - 2.0 / (n * (n - 1)), trials)
