"""Frames written to the shared folder, where lineage ends."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.streaming.run import shared_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read again; a lost executor costs the tasks it was running."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with ``part`` and ``spot``, written: every row of a part comes before those of the next in ``order``, nulls first, and spots rise in that order too.
    Parts are ranges of all of ``order``, as many as the session shuffles into, so neither a value that many rows share nor a growing table makes one of them large."""
    spot = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("spot", spot)
    return written(rows.withColumn("part", F.shiftright("spot", 33)), name)
