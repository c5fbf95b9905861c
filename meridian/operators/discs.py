"""How many points lie within a radius of each place, without making the pairs.

Points at the same place become one row with a count. Places go to square tiles, together with those that may lie within
the radius of a tile's places. In a tile they are cut into columns along x and sorted by y in each column, so that a
disc takes a run of each column that it passes: a difference of two running sums. Only places near the circle, where the
run depends on x, are compared one by one. A tile of many places is cut into blocks that are counted by tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import Rounds

#: A tile is cut into blocks of FINE places, and into SPLITS at most, for its places and those around go to each block.
FINE, SPLITS = 4096, 16
#: Rows that a partition holds, by and large; rows that are counted at once; places near circles compared at once.
PART_ROWS, BATCH, NEAR = 200_000, 65_536, 1 << 21
#: Cells of a quarter of the radius; a tile is 16 cells wide, and 5 cells on all sides hold whatever is within the radius.
#: Beyond FAR cells from the origin all cells are one.
SHIFT, AROUND, FAR = 4, 5, 1 << 50
#: How much squares may differ by rounding, and sums of coordinates.
SQUARE, SUM = 1e-12, 2.0**-50


def _ranges(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(which range, its members, first member of each range) of the ranges lo..hi-1, some NEAR members at a time."""
    size = np.maximum(hi - lo, 0)
    full = np.flatnonzero(size)
    end = np.cumsum(size[full])
    at = 0
    while at < len(full):
        to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + NEAR, "right")))
        own, n = full[at:to], size[full[at:to]]
        first = np.cumsum(n) - n
        yield own, np.repeat(lo[own] - first, n) + np.arange(n.sum()), first
        at = to


def count_within(unit: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, home: np.ndarray, radius: float) -> np.ndarray:
    """For each row with ``home`` the sum of w over the rows of its unit that lie within the radius; units are numbered from 0
    and ascend. The test is dx * dx + dy * dy <= radius * radius in doubles; columns only settle what rounding can't change."""
    square = radius * radius
    of = np.bincount(unit)
    dense = float((of[unit[home]]).mean()) / 42 if home.any() else 0.0  # by the square of the radius; a tile and its surroundings have 42
    k = int(np.clip(np.sqrt(dense) / 4, 4, 64))
    j = np.clip(np.floor(x / (radius / k)), -FAR, FAR).astype(np.int64)
    low = np.full(len(of), np.iinfo(np.int64).max)
    np.minimum.at(low, unit, j)
    j -= low[unit]
    key = unit * (int(j.max()) + 2 * k + 4) + j + k + 2
    order = np.lexsort((y, key))
    sx, sy, sw, skey = x[order], y[order], w[order], key[order]
    start = np.flatnonzero(np.concatenate([[True], skey[1:] != skey[:-1]]))
    columns, least, most = skey[start], np.minimum.reduceat(sx, start), np.maximum.reduceat(sx, start)
    heights = np.unique(sy)
    wide = len(heights) + 1
    spot = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(sx)))) * wide + np.searchsorted(heights, sy)
    run = np.concatenate([[0], np.cumsum(sw)])

    def place(column: np.ndarray, bound: np.ndarray, side: str) -> np.ndarray:
        return np.searchsorted(spot, column * wide + np.searchsorted(heights, bound, side))

    ask = np.flatnonzero(home)
    ask = ask[np.argsort(key[ask], kind="stable")]
    found = np.zeros(len(x), np.int64)
    for off in range(-k - 1, k + 2):
        column = np.searchsorted(columns, key[ask] + off)
        there = column < len(columns)
        there[there] = columns[column[there]] == key[ask[there]] + off
        q, column = ask[there], column[there]
        near = np.maximum(np.maximum(least[column] - x[q], x[q] - most[column]), 0)
        reached = near * near <= square * (1 + SQUARE)
        q, column, near = q[reached], column[reached], near[reached]
        if not len(q):
            continue
        far = np.maximum(x[q] - least[column], most[column] - x[q])
        slack = SUM * (np.abs(y[q]) + radius)
        outer = np.sqrt(square * (1 + SQUARE) - near * near) + slack
        inner = np.sqrt(np.maximum(square * (1 - SQUARE) - far * far, 0)) - slack
        lo, hi = place(column, y[q] - outer, "left"), place(column, y[q] + outer, "right")
        sure = inner > 0
        a, b = lo.copy(), lo.copy()
        a[sure] = place(column[sure], y[q[sure]] - inner[sure], "left")
        b[sure] = np.maximum(a[sure], place(column[sure], y[q[sure]] + inner[sure], "right"))
        found[q] += run[b] - run[a]
        for p, r in ((lo, a), (b, hi)):
            for own, members, first in _ranges(p, r):
                n = r[own] - p[own]
                dx, dy = np.repeat(x[q[own]], n) - sx[members], np.repeat(y[q[own]], n) - sy[members]
                found[q[own]] += np.add.reduceat(np.where(dx * dx + dy * dy <= square, sw[members], 0), first)
    return found[home]


def _count(radius: float):
    names = ("tx", "ty", "block")

    def changes(t: pa.Table) -> np.ndarray:
        cols = [t[c].to_numpy() for c in names]
        return np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in cols])])

    def solve(t: pa.Table) -> pa.RecordBatch:
        x, y, w, home = (t[c].to_numpy() for c in ("x", "y", "w", "home"))
        n = count_within(np.cumsum(changes(t)) - 1, x, y, w, home, radius)
        return pa.RecordBatch.from_arrays([pa.array(x[home]), pa.array(y[home]), pa.array(n)], names=["x", "y", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, due = 0, BATCH
        for batch in batches:  # sorted by block; the last one may go on in the next batch
            held.append(batch)
            rows += batch.num_rows
            if rows < due:
                continue
            table = pa.Table.from_batches(held)
            cut = int(np.flatnonzero(changes(table))[-1])
            if cut:
                yield solve(table.slice(0, cut))
            held, rows = table.slice(cut).to_batches(), len(table) - cut
            due = max(BATCH, 2 * rows)  # a large block isn't looked through again with each batch
        if rows:
            yield solve(pa.Table.from_batches(held))

    return run


def place_density(points: DataFrame, radius: float) -> DataFrame:
    """(x, y, n): how many of points(x, y) lie within ``radius`` (closed, positive) of each place that has points, those there
    included. Points whose coordinates are null or not finite lie within no radius and have no row."""
    spark = points.sparkSession
    rounds = Rounds(spark)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    places = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(finite("x") & finite("y"))
    cell = lambda c: F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.floor(F.col(c) / (radius / 4))))
    places = rounds.keep(places.groupBy("x", "y").agg(F.count("*").alias("w")).withColumns({"cx": cell("x"), "cy": cell("y")}))
    tile = lambda c: F.shiftright(c, SHIFT)
    tiles = places.groupBy(tile("cx").alias("tx"), tile("cy").alias("ty")).agg(F.count("*").alias("m"))
    tiles = rounds.keep(tiles.withColumn("cut", F.least(F.lit(SPLITS), F.ceil(F.col("m") / FINE)).cast("int")))
    rows = tiles.agg(F.sum(F.col("m") * F.col("cut"))).first()[0] or 0
    seen = lambda c: F.explode(F.sequence(F.shiftright(F.col(c) - AROUND, SHIFT), F.shiftright(F.col(c) + AROUND, SHIFT)))
    sent = places.withColumn("tx", seen("cx")).withColumn("ty", seen("cy")).join(tiles.select("tx", "ty", "cut"), ["tx", "ty"])
    sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    own = (tile("cx") == F.col("tx")) & (tile("cy") == F.col("ty")) & (F.pmod(F.xxhash64("x", "y"), F.col("cut")) == F.col("block"))
    sent = sent.select("tx", "ty", "block", "x", "y", "w", own.alias("home"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // PART_ROWS)
    return sent.repartition(parts, "tx", "ty", "block").sortWithinPartitions("tx", "ty", "block").mapInArrow(_count(radius), "x double, y double, n long")
