"""Tables that several relations are derived from, written once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch between Spark and a Python worker; bounds the memory of both.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_BYTES: packages may be large, and ten thousand of them are the default batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def stored(df: DataFrame) -> DataFrame:
    """Write to a new folder below spark.checkpoint.dir, which all executors share, and read back: what it took to make the table isn't done
    again for each use, and the files survive lost executors. Below /tmp on one machine where that is unset; on a cluster that is an error."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file:///tmp/docloom-shared"
    path = f"{root.rstrip('/')}/docloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
