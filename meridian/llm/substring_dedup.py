"""Substring dedup by difference-cover anchors.

A difference cover D modulo v holds, for any two residues, a shift below v that takes both into D. Two equal windows of
``window`` words, wherever they start, therefore share an anchor of ``window - v + 1`` words that starts at a cover
position of either document. Only those anchors are hashed and shuffled (|D|/v of all positions). Around anchors that
occur again the match is extended: every full window that holds such an anchor is hashed in 96 bits, and those that
occur again are what is removed (the last 32 bits from a word hash of their own). Both rounds use one packed shuffle (``repeats``), so a passage that a third of the
documents share never meets in one task, and no pairs of documents are formed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import BLOCK_SCHEMA, Packer, positions_seen_again
from .scratch import Scratch, partitions_for, stable
from .textcore import chunks, kept_text, window_hashes, word_hashes, words

#: Perfect difference sets (every difference but 0 exactly once) by their modulus.
DIFFERENCE_COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest modulus that leaves anchors of at least 12 words, else of at least half a window, else modulus 1."""
    for v in sorted(DIFFERENCE_COVERS, reverse=True):
        if window - v + 1 >= min(12, (window + 1) // 2):
            return v, DIFFERENCE_COVERS[v]
    return 1, (0,)


def _anchors(window: int, parts: int):
    v, cover = cover_for(window)
    size = window - v + 1
    in_cover = np.zeros(v, bool)
    in_cover[list(cover)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(parts)
        for part, data, offs in chunks(batches):
            dk = part.column(0).to_numpy(zero_copy_only=False)
            starts, ends, woff = words(data, offs)
            n = np.diff(woff)
            doc = np.repeat(np.arange(len(n)), n)
            pos = np.arange(len(starts)) - woff[doc]
            at = np.flatnonzero(in_cover[pos % v] & (pos + size <= n[doc]) & (n[doc] >= window))
            if len(at):
                key = window_hashes(word_hashes(data, starts, ends), size)[at]
                yield from packer.add(key, np.zeros(len(at), np.uint32), dk[doc[at]], pos[at])
        yield from packer.flush()

    return run


def _windows(window: int, parts: int):
    v, _ = cover_for(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(parts)
        for part, data, offs in chunks(batches):
            dk = part.column(0).to_numpy(zero_copy_only=False)
            starts, ends, woff = words(data, offs)
            n = np.diff(woff)
            doc_of, anchor = _lists(part.column(2))
            g = woff[doc_of] + anchor
            edge = np.zeros(len(starts) + 1, np.int64)  # windows that hold an anchor seen again, as a difference array
            np.add.at(edge, np.maximum(g - v + 1, woff[doc_of]), 1)
            np.add.at(edge, np.minimum(g, woff[doc_of] + n[doc_of] - window) + 1, -1)
            at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            if len(at):
                key = window_hashes(word_hashes(data, starts, ends), window)[at]
                extra = (window_hashes(word_hashes(data, starts, ends, salt=1), window)[at] >> np.uint64(32)).astype(np.uint32)
                doc = np.searchsorted(woff, at, "right") - 1
                yield from packer.add(key, extra, dk[doc], at - woff[doc])
        yield from packer.flush()

    return run


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of every entry of an array<int> column."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), lengths), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _cover(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in chunks(batches):
            starts, ends, woff = words(data, offs)
            doc_of, first = _lists(part.column(2))
            edge = np.zeros(len(starts) + 1, np.int64)
            np.add.at(edge, woff[doc_of] + first, 1)
            np.add.at(edge, woff[doc_of] + first + window, -1)
            keep = np.cumsum(edge[:-1]) == 0
            kept, removed = [], []
            for a, b in zip(woff[:-1], woff[1:], strict=True):
                own = keep[a:b]
                kept.append(kept_text(data, starts[a:b][own], ends[a:b][own]))
                removed.append(int(len(own) - own.sum()))
            sha = [hashlib.sha256(x).digest() for x in kept]
            cols, names = [part.column(0), pa.array(removed, pa.int64()), pa.array(sha, pa.binary())], ["dk", "n_removed", "kept_sha"]
            if with_text:
                cols.append(pa.array([x.decode() for x in kept], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, with_text: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept_text]), one row for each row of ``docs``.

    Words are maximal runs without ASCII white space. A word goes if a window of ``window`` words that covers it occurs
    again anywhere, in the same document too; all copies go. Null text counts as empty, ids may be null or repeated (rows
    are told apart by their place), other columns are ignored, an empty table gives an empty result. ``with_text`` adds
    the kept words joined by one space (for documents that keep all words their words are joined likewise).
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    scratch = Scratch(docs.sparkSession)
    docs = stable(docs.select(id_col, text_col), scratch)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("dk", F.monotonically_increasing_id())
    parts = partitions_for(docs)
    text = rows.select("dk", "text")
    info = scratch.write(_info(rows), "info")  # a digest a row, read four times
    # copies of whole documents are judged by their digest and enter the second round once
    copies = info.where(f"n_words >= {int(window)}").groupBy("sha").agg(F.min("dk").alias("kept_dk"), F.count("*").alias("n")).where("n > 1").select("sha", "kept_dk")
    copies = scratch.write(copies, "copies")  # a scan, not an aggregate: a hot digest's partition may be split in the join
    judged = info.join(copies, "sha", "left")
    anchors = positions_seen_again(text.mapInArrow(_anchors(window, parts), BLOCK_SCHEMA), parts)
    spare = judged.where("kept_dk is not null and kept_dk <> dk").select("dk")
    near = anchors.join(spare, "dk", "left_anti")
    dealt = text.repartition(parts, "dk")  # shuffled once, read by both rounds
    second = dealt.join(near.hint("shuffle_merge"), "dk").select("dk", "text", "pos").mapInArrow(_windows(window, parts), BLOCK_SCHEMA)
    again = positions_seen_again(second, parts)
    cols = "dk long, n_removed long, kept_sha binary" + (", kept_text string" if with_text else "")
    found = dealt.join(again.hint("shuffle_merge"), "dk").select("dk", "text", "pos").mapInArrow(_cover(window, with_text), cols)
    out = judged.join(found, "dk", "left")
    whole = F.col("kept_dk").isNotNull()
    picked = [
        F.col("id").alias(id_col),
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex(F.coalesce("kept_sha", "sha")))).alias("kept_sha256"),
    ]
    if with_text:
        out = out.join(text.withColumnRenamed("text", "full"), "dk")
        words_only = F.trim(F.regexp_replace("full", "[\\x20\\x09-\\x0D]+", " "))
        picked.append(F.when(whole, F.lit("")).otherwise(F.coalesce("kept_text", words_only)).alias("kept_text"))
    return out.select(*picked)


def _info(rows: DataFrame) -> DataFrame:
    """(dk, n_words, sha, id): the id rides along as its own column."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in chunks(batches):
            starts, ends, woff = words(data, offs)
            sha = [hashlib.sha256(kept_text(data, starts[a:b], ends[a:b])).digest() for a, b in zip(woff[:-1], woff[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(woff), pa.int64()), pa.array(sha, pa.binary()), part.column(2)], names=["dk", "n_words", "sha", "id"])

    return rows.select("dk", "text", "id").mapInArrow(run, f"dk long, n_words long, sha binary, id {kind}")
