"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column, modulus: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; a null id counts as held out, for it has no fold to learn from."""
    return F.coalesce(F.pmod(F.crc32(F.encode(id_col.cast("string"), "UTF-8")), F.lit(modulus)) == rest, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(y, fold, text) of at most ``most`` labelled documents that aren't held out; conflicting labels of an id are left out.

    The sample's ids are the first by hash: at most ``most`` rows, which is the bound for broadcasting them.
    """
    ids = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col(id_col), modulus, rest)).groupBy(id_col).agg(F.min(label).alias("y"), F.max(label).alias("y2"))
    ids = ids.where("y = y2").select(id_col, "y").orderBy(F.xxhash64(id_col), id_col).limit(most)
    rows = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), id_col)
    rows = rows.groupBy(id_col).agg(F.min("y").alias("y"), F.min("text").alias("text"))
    return rows.select("y", F.pmod(F.xxhash64(id_col, F.lit(5)), F.lit(2)).cast("int").alias("fold"), "text")
