"""Tables of a loop's rounds in the folder that driver and executors share.

A written table cuts lineage, survives the loss of any executor, is computed once (a checkpoint is computed twice), and
has a size that Catalyst knows, so a small front is broadcast and a large one isn't.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; one of our own only where that is unset and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="meridian-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Rounds:
    """Tables below one folder of its own, which goes with the session; ``drop`` removes what is no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.n = spark, 0
        self.root = f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}"
        atexit.register(delete, spark, self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.kept_at = path  # type: ignore[attr-defined]
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete(self.spark, t.kept_at)  # type: ignore[attr-defined]


class Labels:
    """The least label of each key, as a table and the changes since; changes are merged every ``MERGE`` rounds, so that a
    round writes what changed and not all that is known."""

    MERGE = 8

    def __init__(self, rounds: Rounds, first: DataFrame, keys: list[str]):
        self.rounds, self.keys = rounds, keys
        self.values = [c for c in first.columns if c not in keys]
        self.tables = [rounds.keep(first)]

    @property
    def front(self) -> DataFrame:
        return self.tables[-1]

    def now(self) -> DataFrame:
        """A later label of a key is less than the one before."""
        if len(self.tables) == 1:
            return self.tables[0]
        every = self.tables[0]
        for t in self.tables[1:]:
            every = every.unionByName(t)
        return every.groupBy(*self.keys).agg(F.min(F.struct(*self.values)).alias("_s")).select(*self.keys, "_s.*")

    def change(self, less: DataFrame) -> bool:
        """Takes in labels that are less than those of their keys; whether there are any."""
        front = self.rounds.keep(less)
        if front.isEmpty():
            return False
        self.tables.append(front)
        if len(self.tables) > self.MERGE:
            merged = self.rounds.keep(self.now())
            self.rounds.drop(*self.tables[:-1])
            self.tables = [merged, front]  # the front is in both, which changes no minimum
        return True
