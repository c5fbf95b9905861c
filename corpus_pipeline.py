"""A corpus pipeline: quality filter, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. ``run`` writes what a stage returns to the shared folder and reads it again for the next. Rows are told
apart by their place, so repeated rows and null ids are documents of their own; columns besides those of documents are
left out; an empty table passes through every stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm.decontaminate import find_contamination
from meridian.llm.line_dedup import drop_recurring_lines
from meridian.llm.near_texts import near_text_groups
from meridian.llm.packing import pack
from meridian.llm.quality_crf import fit_quality, text_quality
from meridian.llm.scratch import Scratch, stable
from meridian.llm.textcore import chunks
from meridian.llm.tokens import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
QUALITY_THRESHOLD = 0.3


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores at QUALITY_THRESHOLD or more; the rows pass through one scan, unshuffled.

    A null text is scored as an empty one and keeps its null. Without labels every score is a half, so all stay.
    """
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in chunks(batches):
            yield part.filter(pa.array(text_quality(model, data, offs) >= QUALITY_THRESHOLD))

    docs = docs.select(*COLUMNS)
    return docs.mapInArrow(run, docs.schema)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines dropped from all documents but the first of each template; n_chars follows the text.

    Every document stays, at worst with an empty text; null texts stay null with the n_chars that they had.
    """
    out = drop_recurring_lines(docs.select(*COLUMNS)).drop("n_lines", "n_dropped")
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def _numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    return stable(docs.select(*COLUMNS), scratch).withColumn("dk", F.monotonically_increasing_id())


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word Jaccard similarity 0.8 stays: that of the smallest id (nulls last), the first
    row on ties. Links come from the SimHash index and from min-hash bands, for fingerprints alone find few pairs at 0.8.

    Null, empty and blank texts are copies of each other, so one of them stays.
    """
    scratch = Scratch(spark)
    rows = _numbered(docs, scratch)
    groups = scratch.write(near_text_groups(rows.select("dk", "text"), scratch, words_each=5, similarity=0.8), "groups")
    ranked = groups.join(rows.select("dk", "doc_id"), "dk")
    first = ranked.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "dk")).alias("m")).select(F.col("m.dk").alias("dk"))
    return rows.join(first, "dk", "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none. Without benchmark rows all stay."""
    scratch = Scratch(spark)
    rows = _numbered(docs, scratch)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("item"), "text")
    found = find_contamination(rows.where("text is not null").select("dk", "text"), bench, scratch=scratch)
    gone = scratch.write(found.select("dk").distinct(), "gone")  # a table of known size, before texts are moved for the join
    return rows.join(gone, "dk", "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences; null texts are pieces of one token."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"), capacity=2048)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]
#: SQL can't express the classifier, the near-duplicate groups or the packing. tests/llm/test_pipeline.py holds near-dedup
#: against brute force and runs every stage on odd rows; tests/llm holds the operators behind the other stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        docs = scratch.write(out, f"stage-{k}")
    return docs
