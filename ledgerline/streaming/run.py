"""Tables read as streams, run to their end and read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a temporary one where it is unset, on a single machine only."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:  # the setting itself is fixed once a session runs
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files. A path with a pattern may be a folder or a single file, which a plain one may not."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def timed_events(spark: SparkSession, sf_dir: str, late: str = "10 minutes") -> DataFrame:
    """The event stream with a time that can be late by that much."""
    return stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def finished(df: DataFrame) -> DataFrame:
    """What the stream gives for all files there are, in append mode. Offsets, state and results are in the shared
    folder of spark.checkpoint.dir, from where a run that breaks off goes on."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    sink = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    sink.start(f"{at}/rows").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/rows")


def rounds(df: DataFrame, each: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``each`` makes of every micro-batch, one folder a batch, so that a batch that runs again replaces its rows."""
    spark, at = df.sparkSession, f"{shared_folder(df.sparkSession)}/rounds-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{at}/rows/round={n}")

    df.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/rows")
