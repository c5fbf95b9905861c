"""Token counts through a digest cache.

Content digests and the tokenizer's own digest are joined to the stored counts; one text of each digest that is missing
is encoded, and its count is appended to the cache for the next run. Only digests travel to the cache: texts are fetched
by row number for the digests that it lacks, so a filled cache leaves texts where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .scratch import Scratch, stable

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def _encode(path: str, ranks: str | None, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path, ranks)
        for batch in batches:
            n = [len(enc.ids(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(n), pa.string()), batch.column(0), pa.array(n, pa.int64())], names=["tokenizer", "digest", "n_tokens"])

    return run


def read_cache(spark, path: str) -> DataFrame:
    """The stored counts; a folder that isn't there yet is an empty cache."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, path: str, ranks: str | None = None, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), one row for each row of ``docs``.

    Normalisation of content is null to empty only, for anything more would change counts. ``cache`` is the folder of the
    stored counts, which later runs read as well (a folder of this run if None). Two runs that append the same digest at
    once store the same count twice, so counts are read by digest as a minimum. Ids may be null or repeated; other columns
    are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    cache = cache or f"{scratch.root}/cache"
    version = tokens.digest(path)
    docs = stable(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), scratch)
    rows = docs.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("dk", F.monotonically_increasing_id())
    sized = scratch.write(rows.select("id", "dk", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")), "sized")
    stored = read_cache(spark, cache).where(F.col("tokenizer") == version)
    # one row for each digest before the cache is asked; copies meet as partial aggregates, never in one task
    missing = sized.groupBy("digest").agg(F.min("dk").alias("dk")).join(stored.select("digest"), "digest", "left_anti")
    missing = scratch.write(missing, "missing")  # a table of known size: Catalyst broadcasts it where few digests are missing
    texts = rows.select("dk", "text").join(missing, "dk").select("digest", "text")
    texts.mapInArrow(_encode(path, ranks, version), CACHE_SCHEMA).write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    counts = scratch.write(counts, "counts")  # a scan, not an aggregate: a hot digest's partition may be split in the join
    return sized.join(counts, "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
