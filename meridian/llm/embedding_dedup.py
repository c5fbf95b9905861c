"""Embedding near-dedup by lattice hashing.

Unit vectors are projected at random to blocks of 8 dimensions, scaled, and decoded to the nearest E8 lattice point of
each block; the points are a vector's cell in one of ``tables`` tables. Each vector also goes to the ``probes`` nearest
neighbouring cells of each table, so two close vectors meet if any of their cells agree. Vectors that meet are compared
by cosine in double precision. Every pair that meets in several cells is counted only in the least cell they share.
The cells are the same for tables of every size (``LATTICE``), so whether two vectors meet depends on these two only. The
strangers in a vector's cells therefore grow with its label's rows.

Equal vectors become one class with a count first. A cell sends out a link count and one component link for each vector,
never its pairs; a cell of more than ``FINE`` vectors is cut into blocks whose pairs are pieces of work of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import e8
from .components import connected_components
from .scratch import MOST_PARTITIONS, Scratch
from .textcore import hook

#: A cell is cut into blocks of FINE vectors, whose pairs are pieces of work that go to many tasks; into SPLITS blocks at
#: most, for each vector travels once for every block of its cell; and cells so large that these would exceed BLOCK vectors
#: into blocks of that size.
FINE, SPLITS, BLOCK = 128, 16, 2048
#: Rows of work that a partition holds at most, by and large.
PART_ROWS = 200_000
#: Tables, blocks, probes. Of 20,000 simulated pairs at cosine 0.93 exactly in 64 dimensions 14 didn't meet; of strangers a
#: share of 1.3e-3 met.
LATTICE = (12, 3, 3)


def projection(dim: int, blocks: int, table: int, seed: int = 7) -> np.ndarray:
    """(dim, 8 * blocks) directions; orthogonal where there is room, so that coordinates of unit vectors have variance 1."""
    g = np.random.default_rng([seed, dim, blocks, table]).normal(size=(dim, 8 * blocks))
    return np.linalg.qr(g)[0] * np.sqrt(dim) if dim >= 8 * blocks else g


def cell_keys(x: np.ndarray, tables: int, blocks: int, probes: int, scale: float) -> np.ndarray:
    """(n, tables * (1 + probes)) cell numbers of unit vectors; the table is part of the number."""
    out = []
    for t in range(tables):
        y = x @ projection(x.shape[1], blocks, t) / scale
        salt = np.random.default_rng([11, t, blocks]).integers(1, 1 << 62, 8 * blocks) * 2 + 1
        keys, far = np.full((len(x), 1), t + 1, np.int64) * np.int64(0x9E3779B97F4A7C), np.zeros((len(x), 1))
        for b in range(blocks):
            points, d = e8.cells(y[:, 8 * b : 8 * b + 8], probes)
            own = (points * salt[8 * b : 8 * b + 8]).sum(axis=2)
            keys = (keys[:, :, None] + own[:, None, :]).reshape(len(x), -1)
            far = (far[:, :, None] + (d - d[:, :1])[:, None, :]).reshape(len(x), -1)
            pick = np.argsort(far, axis=1, kind="stable")[:, : 1 + probes]
            keys, far = np.take_along_axis(keys, pick, axis=1), np.take_along_axis(far, pick, axis=1)
        out.append(keys)
    return np.concatenate(out, axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows in double precision of a column of equally long lists."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # very large or small entries keep finite squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cells(tables: int, blocks: int, probes: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                keys = cell_keys(_matrix(own.column(1)), tables, blocks, probes, scale)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([own.column(0), lists], names=["cid", "cells"])

    return run


def _compare(threshold: float, tables: int):
    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        work = table["work"].to_numpy()
        table = table.combine_chunks()
        cuts = np.flatnonzero(np.concatenate([[True], work[1:] != work[:-1], [True]]))
        us, vs, ns = [], [], []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi - lo < 2:
                continue
            part = table.slice(lo, hi - lo)
            cid, n, side = part["cid"].to_numpy(), part["n"].to_numpy(), part["side"].to_numpy()
            x, cell = _matrix(part["vec"].combine_chunks()), part["cell"].to_numpy()[0]
            cells = part["cells"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(cid), tables, -1)
            left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(len(cid)),) * 2
            links, parent = np.zeros(len(cid), np.int64), np.arange(len(cid))
            for a in range(0, len(left), 512):
                rows = left[a : a + 512]
                i, j = np.nonzero(x[rows] @ x[right].T >= threshold)
                i, j = rows[i], right[j]
                if not side.any():
                    i, j = i[i < j], j[i < j]
                for k in range(0, len(i), 1 << 14):
                    p, q = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
                    both = cells[p][:, :, :, None] == cells[q][:, :, None, :]
                    least = np.where(both.any(axis=3), cells[p], np.iinfo(np.int64).max).min(axis=(1, 2))
                    p, q = p[least == cell], q[least == cell]
                    np.add.at(links, p, n[q])
                    np.add.at(links, q, n[p])
                    hook(parent, p, q)
            hit = np.flatnonzero(links)
            us.append(cid[hit])
            vs.append(cid[parent[hit]])
            ns.append(links[hit])
        if us and sum(map(len, us)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in (us, vs, ns)], names=["u", "v", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:  # sorted by work; the last piece may go on in the next batch
            held.append(batch)
            rows += batch.num_rows
            if rows < 8192:
                continue
            table = pa.Table.from_batches(held)
            work = table["work"].to_numpy()
            cut = int(np.searchsorted(work, work[-1]))
            if cut:
                yield from solve(table.slice(0, cut))
            held, rows = table.slice(cut).to_batches(), len(work) - cut
        if rows:
            yield from solve(pa.Table.from_batches(held))

    return run


def near_duplicate_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, lattice: tuple[int, int, int] = LATTICE, scale: float = 2.5
) -> DataFrame:
    """(id, n_links, component_id, kept), one row for each row of ``vectors``.

    Vectors link if their labels are equal and not null and their cosine is at least ``threshold``; vectors that are null,
    empty, zero or hold null or non-finite components, and vectors of different lengths, don't link. component_id is the
    smallest id reachable, kept tells if it is the row's own id. Rows with equal vectors and labels link with each other.
    A null id links but names no component unless all its component's ids are null. The pairs found
    depend on ``lattice`` (tables, blocks, probes) and never on the number of rows. Other columns are ignored, whatever
    their names; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    vec = F.col(vec_col)
    finite = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))) & F.exists(vec, lambda c: c != 0)
    base = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.when(F.col(label_col).isNotNull() & vec.isNotNull() & finite, vec).alias("vec"))
    keyed = base.withColumn("k1", F.xxhash64("label", "vec")).withColumn("k2", F.xxhash64(F.lit(1), "vec", "label"))
    classes = keyed.where("vec is not null").groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    classes = scratch.write(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    tables, blocks, probes = lattice
    cells = scratch.write(classes.select("cid", "vec").mapInArrow(_cells(tables, blocks, probes, scale), "cid long, cells array<bigint>"), "cells")
    dealt = cells.join(classes.select("cid", F.xxhash64("label", F.size("vec")).alias("ground")), "cid").select("cid", "ground", F.explode("cells").alias("cell"))
    filled = dealt.groupBy("ground", "cell").agg(F.count("*").alias("m")).where("m > 1").select("ground", "cell", "m", F.greatest(F.ceil(F.col("m") / BLOCK), F.least(F.lit(SPLITS), F.ceil(F.col("m") / FINE))).cast("int").alias("cut"))
    filled = scratch.write(filled, "filled")
    rows = filled.agg(F.sum(F.col("m") * F.col("cut"))).first()[0] or 0
    filled = filled.select("ground", "cell", "cut")
    placed = dealt.join(filled, ["ground", "cell"]).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("cut")).cast("int"))
    placed = placed.select("cid", "ground", "cell", "own", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("other"))
    work = F.xxhash64("ground", "cell", F.least("own", "other"), F.greatest("own", "other"))
    pieces = placed.select("cid", "cell", work.alias("work"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    full = pieces.join(classes.select("cid", "n", "vec"), "cid").join(cells, "cid").select("cid", "n", "vec", "cells", "cell", "work", "side")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTITIONS, rows // PART_ROWS))
    met = scratch.write(full.repartition(parts, "work").sortWithinPartitions("work").mapInArrow(_compare(threshold, tables), "u long, v long, links long"), "met")
    groups = connected_components(met.select("u", "v"), scratch)
    links = met.groupBy("u").agg(F.sum("links").alias("links"))
    member = classes.select("cid", "k1", "k2", "n", "least").join(groups.withColumnRenamed("node", "cid"), "cid", "left").join(links.withColumnRenamed("u", "cid"), "cid", "left")
    member = member.withColumn("component", F.coalesce("component", "cid"))
    low = member.groupBy("component").agg(F.min("least").alias("component_id"))
    every = member.join(low, "component").select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    sound = keyed.where("vec is not null").select("id", "k1", "k2").join(every, ["k1", "k2"]).select("id", "n_links", "component_id")
    rest = keyed.where("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return sound.unionByName(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
