"""Tables written to the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``; one of our own is set only where that is unset (tests).
A written table cuts lineage and survives the loss of any executor, unlike a local checkpoint.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="meridian-scratch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Named tables below one folder of its own; ``drop`` removes those that are no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/meridian-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.root}/{name}")


#: Shuffle partitions at most; beyond that they grow, for a shuffle's bookkeeping on the driver grows with their number.
MOST_PARTITIONS = 200_000


def partitions_for(df: DataFrame, mb_each: int = 16) -> int:
    """Shuffle partitions that hold about ``mb_each`` MB of the input's files each (more beyond MOST_PARTITIONS of them),
    never fewer than the session's setting.

    The size is Catalyst's estimate from file sizes, so nothing is read.
    """
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > 1 << 56:  # no estimate
        return least
    return max(least, min(MOST_PARTITIONS, -(-size // (mb_each << 20))))


def stable(df: DataFrame, scratch: Scratch, name: str = "input") -> DataFrame:
    """``df`` if every run of its plan gives its rows in the same partitions and order, else a written copy.

    Row numbers from monotonically_increasing_id() agree between two branches of a plan only over such an input:
    projections and filters of file scans and of local rows. Anything else (joins, shuffles, Python) is written first.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {re.match(r"[\s:+\-|]*(\w+)", line)[1] for line in plan.splitlines() if re.match(r"[\s:+\-|]*(\w+)", line)}
    if nodes <= {"Project", "Filter", "Relation", "LocalRelation"} and not re.search(r"\b(rand|randn|uuid|shuffle)\(", plan):
        return df
    return scratch.write(df, name)
