"""SimHash fingerprints and near-duplicate groups by a Gray-order hierarchical index.

Fingerprints are grouped first (copies become one entry). Two of them that differ in at most ``max_bits`` bits agree
wholly in ``b - max_bits`` of any ``b`` blocks of bits, so each entry is dealt to one partition of work for each choice
of that many blocks: the chosen bits are the topmost masked pattern of the index, shared by all below it. Below it the
entries are sorted by the rank of their bits in Gray order, consecutive entries form nodes that hold the bits all their
members share, and nodes are compared level by level: the differences in bits that both nodes share can only grow
further down, so a pair of nodes beyond ``max_bits`` is dropped with all its members. What remains is compared in full.

A node of work sends out one link for each entry (to the least of its local group), never its pairs. A top node with more
than ``BLOCK`` entries is cut into blocks and each pair of blocks is a piece of work of its own, whatever its size.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch, partitions_for
from .textcore import buffers, hook

#: Entries of a top node that are compared within one piece of work; larger nodes are cut into blocks of this size.
BLOCK = 4096
#: Children of an index node, and pairs of nodes that are expanded at once.
FANOUT, FRONTIER = 8, 1 << 18


def fingerprint(text: bytes, words_each: int = 4, seed: int = 42) -> int:
    """The fingerprint of one text; see ``fingerprints``."""
    w = text.lower().split()  # bytes: lowers A-Z and splits at ASCII white space only
    if not w:
        return 0
    k = min(words_each, len(w))
    whole = b" ".join(w)
    at, lo = 0, []
    for x in w:
        lo.append(at)
        at += len(x) + 1
    lo.append(at)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(whole[a : b - 1], seed) for a, b in zip(lo, lo[k:], strict=False)), np.uint64, len(w) - k + 1)
    bits = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(h)).tobytes(), "big")


def _fingerprints(words_each: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column(1))
            raw = data.tobytes()
            fp = np.fromiter((fingerprint(raw[a:b], words_each, seed) for a, b in itertools.pairwise(offs.tolist())), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp long). A-Z lowered, words split at ASCII white space, shingles of ``words_each`` words with repeats
    (fewer words: all of them as one), XXH64 of each; a bit is set if it is set in over half of them. No words: 0."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_fingerprints(words_each, seed), f"id {kind}, fp long")


def block_choices(n: int, max_bits: int, per_node: int = 512) -> list[int]:
    """Masks whose bits two close fingerprints share in at least one case; more blocks, and so longer masks, for more entries.

    Any number of blocks finds every pair: it changes the work only."""
    for b in range(max_bits + 1, max_bits + 5):
        cut = [64 * i // b for i in range(b + 1)]
        blocks = [((1 << cut[i + 1]) - 1) ^ ((1 << cut[i]) - 1) for i in range(b)]
        keep = b - max_bits
        if n >> (64 * keep // b) < per_node:
            break
    return [sum(x) for x in itertools.combinations(blocks, keep)]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Where a word stands in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Levels of (shared mask, shared pattern) over entries that are sorted by group and then by Gray rank."""

    def __init__(self, group: np.ndarray, fp: np.ndarray, fanout: int = FANOUT):
        """group: sorted, dense from 0. fp: within a group in Gray order."""
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.masks, self.bits, self.first = [np.full(len(fp), full)], [fp], []
        while len(group) > group[-1] + 1:
            start = np.searchsorted(group, np.arange(group[-1] + 2))
            rank = np.arange(len(group)) - start[group]
            lead = np.flatnonzero(rank % fanout == 0)
            mask, bits = self.masks[-1], self.bits[-1]
            # a bit is shared by a node if all children share it and agree on it
            all_on = np.bitwise_and.reduceat(mask & bits, lead)
            all_off = np.bitwise_and.reduceat(mask & ~bits, lead)
            self.first.append(np.append(lead, len(group)))
            self.masks.append(all_on | all_off)
            self.bits.append(all_on)
            group = group[lead]

    def close_pairs(self, a: np.ndarray, b: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Entries (i, j) below the pairs of top nodes (a, b) that differ in at most ``most`` bits; a == b gives i < j."""
        work = [(len(self.first), a, b)]
        while work:
            level, a, b = work.pop()
            if len(a) > FRONTIER:
                half = len(a) // 2
                work += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            differ = np.bitwise_count((self.bits[level][a] ^ self.bits[level][b]) & self.masks[level][a] & self.masks[level][b])
            near = differ <= most
            a, b = a[near], b[near]
            if level == 0:
                own = a != b
                if own.any():
                    yield a[own], b[own]
                continue
            if not len(a):
                continue
            first = self.first[level - 1]
            na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
            n = na * nb
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat(nb, n)
            i, j = np.repeat(first[a], n) + k // wide, np.repeat(first[b], n) + k % wide
            once = i <= j if level > 1 else i < j
            once |= np.repeat(a != b, n)
            work.append((level - 1, i[once], j[once]))


def _link(max_bits: int):
    def solve(table: pa.Table) -> pa.RecordBatch | None:
        fp = table["fp"].to_numpy().view(np.uint64)
        node = table["rep"].to_numpy()
        work, side = table["work"].to_numpy(), table["side"].to_numpy()
        bits = table["top"].to_numpy().view(np.uint64)
        rank = gray_rank(fp & ~bits)
        order = np.lexsort((rank, side, work))
        fp, node, work, side = fp[order], node[order], work[order], side[order]
        new = np.concatenate([[True], (work[1:] != work[:-1]) | (side[1:] != side[:-1])])
        group = np.cumsum(new) - 1
        index = GrayIndex(group, fp)
        lead = np.flatnonzero(new)
        both = np.flatnonzero(work[lead][1:] == work[lead][:-1])  # two sides: compare across only
        alone = np.setdiff1d(np.arange(len(lead)), np.concatenate([both, both + 1]))
        parent = np.arange(len(fp))
        for i, j in index.close_pairs(np.concatenate([alone, both]), np.concatenate([alone, both + 1]), max_bits):
            hook(parent, i, j)
        tail = np.flatnonzero(parent != np.arange(len(fp)))
        if len(tail):
            return pa.RecordBatch.from_arrays([pa.array(node[tail]), pa.array(node[parent[tail]])], names=["u", "v"])
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:  # sorted by work: a piece of work may go on in the next batch
            held.append(batch)
            rows += batch.num_rows
            if rows < 1 << 16:
                continue
            table = pa.Table.from_batches(held)
            work = table["work"].to_numpy()
            cut = int(np.searchsorted(work, work[-1]))
            if cut and (out := solve(table.slice(0, cut))) is not None:
                yield out
            held, rows = table.slice(cut).to_batches(), len(work) - cut
        if rows and (out := solve(pa.Table.from_batches(held))) is not None:
            yield out

    return run


def hamming_links(entries: DataFrame, n: int, max_bits: int = 4, parts: int | None = None) -> DataFrame:
    """(u, v): links of the entries (fp long, rep long; fp distinct) whose groups are those of all pairs within ``max_bits``."""
    spark = entries.sparkSession
    masks = block_choices(n, max_bits)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    parts = max(parts or 0, int(spark.conf.get("spark.sql.shuffle.partitions")), n * len(masks) >> 21)
    tops = F.explode(F.array(*[F.struct(F.lit(k).alias("choice"), F.lit(m).cast("long").alias("top")) for k, m in enumerate(signed)]))
    dealt = entries.select("fp", "rep", tops.alias("t")).select("fp", "rep", "t.choice", "t.top", F.col("fp").bitwiseAND(F.col("t.top")).alias("shared"))
    large = dealt.groupBy("choice", "shared").agg(F.count("*").alias("n")).where(f"n > {BLOCK}").select("choice", "shared", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    cut = dealt.join(large, ["choice", "shared"], "left").withColumn("own", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("blocks"))).cast("int"))
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("other")
    pairs = cut.select("fp", "rep", "choice", "top", "shared", "own", other)
    work = F.xxhash64("choice", "shared", F.least("own", "other"), F.greatest("own", "other"))
    pieces = pairs.select("fp", "rep", "top", work.alias("work"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    return pieces.repartition(parts, "work").sortWithinPartitions("work").mapInArrow(_link(max_bits), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 4, max_bits: int = 4) -> DataFrame:
    """(id, fingerprint, component_id), one row for each row of ``docs``.

    Rows whose fingerprints differ in at most ``max_bits`` bits are linked; component_id is the smallest id reachable.
    Null text counts as empty; all texts without words share fingerprint 0. Null ids take part and get the component's
    smallest non-null id (null if there is none). Repeated rows give repeated rows, an empty table an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.write(fingerprints(docs, id_col, text_col, words_each).withColumnRenamed("id", id_col), "prints")
    distinct = scratch.write(prints.groupBy("fp").agg(F.min(id_col).alias("least")).withColumn("rep", F.monotonically_increasing_id()), "distinct")
    links = hamming_links(distinct.select("fp", "rep"), distinct.count(), max_bits, partitions_for(distinct))
    groups = connected_components(links, scratch)
    member = groups.join(distinct.select(F.col("rep").alias("node"), "fp", "least"), "node")
    least = member.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = member.join(least, "component").select("fp", "component_id")
    every = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    every = scratch.write(every, "every")  # a scan, not a join: a hot fingerprint's partition may be split below
    return prints.join(every, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
