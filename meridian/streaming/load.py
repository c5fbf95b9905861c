"""Hourly load as a stream: late rows within the delay still count, closed hours are emitted once."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rounds import delete, shared_folder


def windowed_load(events: DataFrame, ts: str, delay: str = "1 hour") -> DataFrame:
    """(hour, n) of a stream of events, by hour, under a watermark."""
    timed = events.select(F.col(ts).cast("timestamp").alias("ts")).where("ts is not null").withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "n")


def closed_hours(spark: SparkSession, path: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """Reads a Parquet folder or file as a stream to its present end and returns the hours that closed.

    State and result are in the shared folder; the state goes with the run, the result with the session.
    """
    root = f"{shared_folder(spark)}/load-{uuid.uuid4().hex}"
    atexit.register(delete, spark, root)
    schema = spark.read.parquet(path).schema
    reader, target = spark.readStream.schema(schema), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        reader, path = reader.option("pathGlobFilter", target.getName()), target.getParent().toString()  # a stream reads folders
    hours = windowed_load(reader.parquet(path), ts, delay)
    stream = hours.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/state").option("path", f"{root}/hours").trigger(availableNow=True).start()
    stream.awaitTermination()
    delete(spark, f"{root}/state")
    return spark.read.schema(hours.schema).parquet(f"{root}/hours")
