"""Which positions carry a key that occurs more than once anywhere, in one shuffle of packed blocks.

A task packs the keys of about a million positions into one block for each target partition. Keys that the task
itself has seen twice need no further proof: their positions go out as *known*, spread over all partitions by
document, and the key's own partition gets just one flagged entry from this task. So a key that every document holds
costs its partition one entry for each block, however many positions have it; nothing is dropped or sampled.

Up to ``DIRECT`` partitions blocks go straight to their target. For more of them blocks go to a region of partitions first
and are cut up there, both ways, so that a task writes about the square root of ``parts`` blocks for each million positions
and blocks don't shrink as the data grows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_SCHEMA = "part int, known boolean, keys binary, extra binary, flags binary, dk binary, pos binary"
_ARROW = pa.schema([("part", pa.int32()), ("known", pa.bool_()), ("keys", pa.binary()), ("extra", pa.binary()), ("flags", pa.binary()), ("dk", pa.binary()), ("pos", pa.binary())])
#: Positions that are packed together.
BLOCK_ROWS = 1 << 20
#: Target partitions that blocks are sent to without a stop in between.
DIRECT = 2048


def regions(parts: int) -> tuple[int, int]:
    """(regions, partitions of a region) for a two-step way, (parts, 1) for a direct one."""
    if parts <= DIRECT:
        return parts, 1
    each = math.isqrt(parts - 1) + 1
    return -(-parts // each), each


class Packer:
    """Collects (key, extra, dk, pos) and turns them into blocks for the regions of ``parts`` partitions."""

    def __init__(self, parts: int):
        self.parts, self.each, self.held, self.rows = parts, regions(parts)[1], [], 0

    def add(self, key: np.ndarray, extra: np.ndarray, dk: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(key):
            self.held.append((key, extra, dk, pos))
            self.rows += len(key)
        if self.rows >= BLOCK_ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        key, extra, dk, pos = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.rows = [], 0
        order, again, first = _runs(key, extra)
        hit = np.sort(order[again])
        one = np.sort(order[first])  # an entry for each key, in the order of the text
        flag = np.zeros(len(key), bool)
        flag[order[again]] = True
        out = [*_known_blocks(dk[hit], pos[hit], self.parts, self.each), *_key_blocks(key[one], extra[one], flag[one], dk[one], pos[one], self.parts, self.each)]
        yield _batch(out, _ARROW)


def _batch(blocks: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*blocks, strict=True), schema.types, strict=True)], schema=schema)


def _known_blocks(dk: np.ndarray, pos: np.ndarray, parts: int, each: int) -> Iterator[tuple]:
    for p, i in _split(_bucket(dk, parts) // np.uint64(each)):
        yield p, True, b"", b"", b"", dk[i].tobytes(), _wide(pos[i])


def _key_blocks(key: np.ndarray, extra: np.ndarray, flag: np.ndarray, dk: np.ndarray, pos: np.ndarray, parts: int, each: int) -> Iterator[tuple]:
    for p, i in _split(key % np.uint64(parts) // np.uint64(each)):
        yield p, False, key[i].tobytes(), extra[i].tobytes(), np.packbits(flag[i]).tobytes(), dk[i].tobytes(), _wide(pos[i])


def _wide(pos: np.ndarray) -> bytes:
    """Positions as low and high halves, so that the mostly empty high halves compress away."""
    return (pos & 0xFFFF).astype("<u2").tobytes() + (pos >> 16).astype("<u2").tobytes()


def _narrow(raw: bytes) -> np.ndarray:
    half = np.frombuffer(raw, "<u2").astype(np.int32).reshape(2, -1)
    return half[0] | half[1] << 16


def _split(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each partition that occurs, with its entries in their order."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(part[order][1:] != part[order][:-1]) + 1
    for a, b in itertools.pairwise([0, *cuts.tolist(), len(part)] if len(part) else []):
        yield int(part[order[a]]), order[a:b]


def _runs(key: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A sorted order; which of it share their key with a neighbour; which of it come first of their key."""
    order = np.argsort(key, kind="stable")
    k, e = key[order], extra[order]
    same = k[1:] == k[:-1]
    if (same & (e[1:] != e[:-1])).any():  # equal in the first 64 bits only
        order = np.lexsort((extra, key))
        k, e = key[order], extra[order]
        same = k[1:] == k[:-1]
    same &= e[1:] == e[:-1]
    first = np.ones(len(k), bool)
    first[1:] = ~same
    again = np.zeros(len(k), bool)
    again[1:] |= same
    again[:-1] |= same
    return order, again, first


def _bucket(dk: np.ndarray, parts: int) -> np.ndarray:
    return ((dk.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts)


def _unpacked(row: dict) -> tuple[np.ndarray, ...]:
    key = np.frombuffer(row["keys"], np.uint64)
    flag = np.unpackbits(np.frombuffer(row["flags"], np.uint8), count=len(key)).astype(bool)
    return key, np.frombuffer(row["extra"], np.uint32), flag, np.frombuffer(row["dk"], np.int64), _narrow(row["pos"])


def _dealt(parts: int):
    """From blocks by region to blocks by partition, about BLOCK_ROWS positions at a time."""

    def cut(known: list[tuple], keyed: list[tuple]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        if known:
            out += _known_blocks(*(np.concatenate(x) for x in zip(*known, strict=True)), parts, 1)
        if keyed:
            out += _key_blocks(*(np.concatenate(x) for x in zip(*keyed, strict=True)), parts, 1)
        if out:
            yield _batch(out, _ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, keyed, rows = [], [], 0
        for batch in batches:
            for row in batch.to_pylist():
                x = _unpacked(row)
                known.append(x[3:]) if row["known"] else keyed.append(x)
                rows += len(x[3])
                if rows >= BLOCK_ROWS:
                    yield from cut(known, keyed)
                    known, keyed, rows = [], [], 0
        yield from cut(known, keyed)

    return run


def _seen_again(parts: int):
    """From blocks by key to known blocks by document's region: the positions whose key was seen again."""
    each = regions(parts)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed, hits = [], []
        for batch in batches:
            for row in batch.to_pylist():
                x = _unpacked(row)
                hits.append(x[3:]) if row["known"] else keyed.append(x)
        if keyed:
            key, extra, flag, dk, pos = (np.concatenate(x) for x in zip(*keyed, strict=True))
            order, again, _ = _runs(key, extra)
            hit = np.sort(order[again])
            hit = hit[~flag[hit]]  # the positions of flagged entries are known already
            hits.append((dk[hit], pos[hit]))
        if hits:
            out = list(_known_blocks(*(np.concatenate(x) for x in zip(*hits, strict=True)), parts, each))
            if out:
                yield _batch(out, _ARROW)

    return run


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(np.frombuffer(row["dk"], np.int64), _narrow(row["pos"])) for batch in batches for row in batch.to_pylist()]
    if not held:
        return
    dk, pos = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(dk, kind="stable")
    dk, pos = dk[order], pos[order]
    cut = np.flatnonzero(np.concatenate([[True], dk[1:] != dk[:-1]]))
    lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(dk)).astype(np.int32)), pa.array(pos, pa.int32()))
    whole = pa.RecordBatch.from_arrays([pa.array(dk[cut]), lists], names=["dk", "pos"])
    for at in range(0, whole.num_rows, 5_000):
        yield whole.slice(at, 5_000)


def positions_seen_again(blocks: DataFrame, parts: int) -> DataFrame:
    """(dk long, pos array<int>), one row for each document that has any, from blocks of BLOCK_SCHEMA made by Packer(parts).

    Positions travel back in blocks too: a partition sends one block to each region or partition of documents.
    """
    areas, each = regions(parts)

    def home(df: DataFrame) -> DataFrame:
        if each > 1:
            df = df.repartitionById(areas, "part").mapInArrow(_dealt(parts), BLOCK_SCHEMA)
        return df.repartitionById(parts, "part")

    return home(home(blocks).mapInArrow(_seen_again(parts), BLOCK_SCHEMA)).mapInArrow(_by_document, "dk long, pos array<int>")
