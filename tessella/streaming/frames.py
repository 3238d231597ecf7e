"""Frames as a stream: any pixel operator over micro-batches of images."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_frames(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of pixels as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def process(frames: DataFrame, operator: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Apply a batch operator to each micro-batch; a batch that is run again overwrites its own folder."""

    def each(batch: DataFrame, epoch: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{sink}/batch={epoch}")

    return frames.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
