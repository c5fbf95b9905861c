"""Near-duplicate groups of texts by SimHash, completed by min-hash bands, verified by the Jaccard similarity of the texts.

A text's shingles are its distinct runs of ``words_each`` words (A-Z lowered, split at ASCII white space; fewer words: all
of them as one). Each text has a SimHash fingerprint of its shingles; texts that the Gray-order index (``simhash``) puts
into one group are checked against the group's first. A fingerprint can't find all pairs of similarity 0.8: they differ in
9.7 of 64 bits on average, and masked patterns short enough for that many are shared by most of a large table. So texts
also meet in bands: ``EACH`` of ``BANDS * EACH`` min-hashes, with probability 1 - (1 - s**EACH)**BANDS at similarity s,
0.99997 at 0.8. Every link is verified on the texts, wherever it comes from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .linking import linked_groups
from .scratch import Scratch, partitions_for
from .simhash import hamming_links
from .textcore import JOIN, U64, buffers, chunks, mix, whole_hashes, window_hashes, word_hashes, words

BANDS, EACH = 20, 4
_RNG = np.random.default_rng(11)
_TIMES, _PLUS = _RNG.integers(0, 2**63, BANDS * EACH).astype(U64) * U64(2) + U64(1), _RNG.integers(0, 2**63, BANDS * EACH).astype(U64)


def _word_terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends, at = words(lower, offs)
    return word_hashes(lower, starts, ends), at


def shingles(terms: np.ndarray, at: np.ndarray, words_each: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every text's distinct shingles, by row."""
    n = np.diff(at)
    count = np.where(n >= words_each, n - words_each + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), count)
    first = at[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    runs = window_hashes(terms, words_each)
    h = runs[np.minimum(first, len(runs) - 1)] if len(runs) else np.zeros(len(row), U64)
    few = n[row] < words_each
    h[few] = whole_hashes(terms, at)[row[few]]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def bands(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """n x BANDS keys; rows without shingles keep zeros."""
    out = np.zeros((n, BANDS), U64)
    if not len(h):
        return out
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            key = np.full(len(first), U64(b))
            for j in range(b * EACH, (b + 1) * EACH):
                key = mix(key * JOIN + np.minimum.reduceat(h * _TIMES[j] + _PLUS[j], first))
            out[row[first], b] = key
    return out


def fingerprints(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """n SimHash fingerprints: a bit is set if it is set in over half of the row's shingle hashes; rows without any keep 0."""
    ones = np.zeros((n, 64), np.int64)
    for a in range(0, len(h), 1 << 18):
        own = row[a : a + (1 << 18)]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        bits = np.unpackbits(h[a : a + (1 << 18)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    half = np.bincount(row, minlength=n)[:, None]
    return np.packbits(ones * 2 > half, axis=1).view(">u8").ravel().astype(U64)


def _sketch(words_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in chunks(batches):
            terms, at = _word_terms(data, offs)
            row, h = shingles(terms, at, words_each)
            keys = bands(row, h, part.num_rows)
            none = np.bincount(row, minlength=part.num_rows) == 0
            size = np.where(none, 0, BANDS)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(keys[~none].reshape(-1).view(np.int64)))
            whole = [pa.array(whole_hashes(terms, at, salt).view(np.int64)) for salt in (0, 1)]
            fp = pa.array(fingerprints(row, h, part.num_rows).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), *whole, fp, lists], names=["dk", "d1", "d2", "fp", "keys"])

    return run


def _similar(words_each: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in chunks(batches):
            n = part.num_rows
            sets = []
            for d, o in ((data, offs), buffers(part.column(part.schema.get_field_index("other")))):
                row, h = shingles(*_word_terms(d, o), words_each)
                with np.errstate(over="ignore"):
                    sets.append((row, mix(h + row.astype(U64) * JOIN)))
            (ra, a), (rb, b) = sets
            both = np.bincount(ra[np.intersect1d(a, b, assume_unique=True, return_indices=True)[1]], minlength=n)
            either = np.bincount(ra, minlength=n) + np.bincount(rb, minlength=n) - both
            yield part.filter(pa.array(both >= similarity * either - 1e-9)).select(["u", "v"])

    return run


def near_text_groups(docs: DataFrame, scratch: Scratch, words_each: int = 5, similarity: float = 0.8, max_bits: int = 4) -> DataFrame:
    """(dk, component) for each row of ``docs(dk long, text)``; component is some dk of the group.

    Texts of equal words are copies; null, empty and blank texts are copies of each other. Copies are one entry, and
    entries whose shingles' Jaccard similarity is ``similarity`` or more are linked, over any chain of links. ``max_bits``
    is the radius of the fingerprints' index; it decides where links come from, not which there are.
    """
    docs = docs.select("dk", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sketch = scratch.write(docs.mapInArrow(_sketch(words_each), "dk long, d1 long, d2 long, fp long, keys array<long>"), "sketch")
    entries = scratch.write(sketch.groupBy("d1", "d2").agg(F.min("dk").alias("rep"), F.first("fp").alias("fp")), "entries")
    of_rep = sketch.join(entries.select(F.col("rep").alias("dk")), "dk", "left_semi")
    members = scratch.write(of_rep.select(F.explode("keys").alias("key"), F.col("dk").alias("node")), "members")

    def verified(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("u", "v")).alias("dk")).distinct()
        texts = docs.join(ends, "dk", "left_semi")
        both = pairs.join(texts.select(F.col("dk").alias("u"), "text"), "u").join(texts.select(F.col("dk").alias("v"), F.col("text").alias("other")), "v")
        return both.select("u", "v", "text", "other").mapInArrow(_similar(words_each, similarity), "u long, v long")

    # groups of the fingerprints' index: each member against the group's first
    prints = scratch.write(entries.groupBy("fp").agg(F.min("rep").alias("rep")), "prints")
    near = connected_components(hamming_links(prints, prints.count(), max_bits, partitions_for(prints)), Scratch(docs.sparkSession))
    heads = prints.join(near.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("u"))
    heads = scratch.write(heads, "heads")  # a scan: a hot fingerprint's partition may be split in the join
    stars = scratch.write(entries.select("fp", F.col("rep").alias("v")).join(heads, "fp").where("u <> v").select("u", "v"), "fp-stars")
    known = scratch.write(verified(stars), "fp-links")
    groups = linked_groups(members, verified, scratch, known)
    named = entries.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    named = scratch.write(named, "named")  # likewise for a text with very many copies
    return sketch.select("dk", "d1", "d2").join(named, ["d1", "d2"]).select("dk", "component")
