"""Packing of documents into sequences by swap-based local search.

Documents become pieces of token ids; full pieces are sequences of their own. The others are dealt by hash into groups of
about ``GROUP`` pieces (only lengths travel). Local search packs each group, from two plain starts (bins filled in the
order of the rows, and a bin for each piece), of which the better end stays: bins below capacity take a piece over,
exchange one piece for one, or one for two, with bins no fuller than they are. Each step raises the sum of squared fills,
so full bins get fuller, small ones run empty and are dropped; a search ends when no step is left.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .scratch import Scratch

#: Pieces of a group: what one task packs. A group leaves about one bin part empty, some 0.2 % of its bins.
GROUP = 4096


def in_order(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins filled in the given order; a piece that doesn't fit opens the next bin."""
    bins: list[list[int]] = []
    fill = capacity
    for i, n in enumerate(lengths):
        if fill + n > capacity:
            bins.append([])
            fill = 0
        bins[-1].append(i)
        fill += n
    return bins


class _Givers:
    """Which piece lengths, and which sums of two, the bins that may give hold; bit sets answer "the largest up to m"."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.bins, self.lengths = bins, lengths
        self.low = [(1 << (m + 1)) - 1 for m in range(capacity + 1)]
        self.at: tuple[list[dict], list[dict]] = tuple([{} for _ in range(capacity + 1)] for _ in range(2))
        self.mask = [0, 0]

    def _keys(self, b: int) -> tuple[list[int], set[int]]:
        count = Counter(self.lengths[i] for i in self.bins[b])
        single = sorted(count)
        return single, {x + y for k, x in enumerate(single) for y in single[k if count[x] > 1 else k + 1 :]}

    def add(self, b: int) -> None:
        for kind, keys in enumerate(self._keys(b)):
            for n in keys:
                self.at[kind][n][b] = None
                self.mask[kind] |= 1 << n

    def remove(self, b: int) -> None:
        for kind, keys in enumerate(self._keys(b)):
            for n in keys:
                held = self.at[kind][n]
                del held[b]
                if not held:
                    self.mask[kind] &= ~(1 << n)

    def largest(self, kind: int, most: int) -> int:
        """The greatest length (kind 0) or sum of two (kind 1) that a bin can give, up to ``most``; 0 if there is none."""
        return max(0, (self.mask[kind] & self.low[min(most, len(self.low) - 1)]).bit_length() - 1)

    def take(self, kind: int, n: int) -> tuple[int, list[int]]:
        """A bin, the last one put in, and its one or two pieces of that length or sum."""
        b = next(reversed(self.at[kind][n]))
        if not kind:
            return b, [next(i for i in self.bins[b] if self.lengths[i] == n)]
        first: dict[int, int] = {}
        for i in self.bins[b]:
            if (j := first.get(n - self.lengths[i])) is not None:
                return b, [j, i]
            first.setdefault(self.lengths[i], i)
        raise AssertionError("the index holds a sum that the bin doesn't")


def improve(lengths: list[int], bins: list[list[int]], capacity: int, made: Counter | None = None) -> list[list[int]]:
    """Local search from ``bins`` until no move, one-for-one or two-for-one exchange raises the sum of squared fills that way.

    Bins are filled from the fullest down. A bin takes the step that fills it most, from any bin that comes after it, and
    leaves the index once none is left; sweeps go on until one changes nothing. ``made`` counts the steps by kind.
    """
    bins = [list(b) for b in bins]
    fill = [sum(lengths[i] for i in b) for b in bins]
    made = Counter() if made is None else made
    changed = True
    while changed:
        changed = False
        open_ = sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: -fill[b])
        givers = _Givers(bins, lengths, capacity)
        for b in open_:
            givers.add(b)
        for a in open_:
            if not fill[a]:
                continue
            givers.remove(a)
            while fill[a] < capacity:
                gap = capacity - fill[a]
                best = (givers.largest(0, gap), 2, 0, 0, "move")  # (gain, fewer pieces left elsewhere first, kind, length out, name)
                for out in sorted({lengths[i] for i in bins[a]}):
                    if best[0] == gap:
                        break
                    two, one = givers.largest(1, out + gap) - out, givers.largest(0, out + gap) - out
                    best = max(best, (two, 1, 1, out, "two for one"), (one, 0, 0, out, "one for one"))
                gain, _, kind, out, name = best
                if gain <= 0:
                    break
                b, into = givers.take(kind, gain + out)
                givers.remove(b)
                given = [next(i for i in bins[a] if lengths[i] == out)] if out else []
                bins[b] = [i for i in bins[b] if i not in into] + given
                bins[a] = [i for i in bins[a] if i not in given] + into
                fill[a] += gain
                fill[b] -= gain
                if fill[b]:
                    givers.add(b)
                made[name] += 1
                changed = True
    return [b for b in bins if b]


def search(lengths: list[int], capacity: int) -> list[list[int]]:
    return min((improve(lengths, start, capacity) for start in (in_order(lengths, capacity), [[i] for i in range(len(lengths))])), key=len)


def _pieces(path: str, ranks: str | None, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path, ranks)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                raw = np.array([*enc.ids(text), end_id], dtype="<u4")
                first = (len(raw) - 1) % capacity + 1  # what full pieces leave over comes first
                for p, at in enumerate([0, *range(first, len(raw), capacity)]):
                    part = raw[at : at + capacity if p else first]
                    row.append(k)
                    piece.append(p)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            ids = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32"])

    return run


def _pack(capacity: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row", ignore_index=True)
        lengths = group["length"].tolist()
        bins = search(lengths, capacity)
        seq, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for b, members in enumerate(bins):
            at = 0
            for i in members:
                seq[i], offset[i] = int(key[0]) << 20 | b, at
                at += lengths[i]
        return pd.DataFrame({"row": group["row"], "sequence_id": seq, "offset": offset})

    return run


def pack(docs: DataFrame, path: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece.

    A document's ids are its tokens and ``end_id``; longer than ``capacity``, they are cut into full pieces, of which only
    the first may be shorter. Null text counts as empty (one id). Ids may be null or repeated: each row has pieces of its
    own. Pieces of equal length are told apart by their row. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    made = rows.mapInArrow(_pieces(path, ranks, capacity, end_id), f"id {kind}, piece int, start long, length long, ids_crc32 long")
    pieces = scratch.write(made.withColumn("row", F.monotonically_increasing_id()), "pieces")
    open_ = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-open_.count() // GROUP))
    dealt = open_.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group"))
    packed = dealt.groupBy("group").applyInPandas(_pack(capacity), "row long, sequence_id long, offset long")
    placed = open_.join(packed, "row").drop("row")
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long")).drop("row")
    return placed.unionByName(full).withColumnRenamed("id", id_col)
