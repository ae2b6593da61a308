"""Inspection of packages as they arrive: the batch queries over a file stream, exactly once by checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arrivals(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, content of packages that appear in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.docx").load(path)
    return files.select(F.col("path").alias("doc_id"), "content")


def write_each(files: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Apply a batch plan to each micro-batch; a batch that is run again writes the same folder again."""

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
