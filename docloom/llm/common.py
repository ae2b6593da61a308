"""Helpers that every operator of this package shares."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of the package's word and text rules: space and the bytes 9 to 13.
SPACE = b" \t\n\x0b\x0c\r"
#: Text bytes that one numpy step works on; bounds a Python worker's memory.
STEP_BYTES = 1 << 20
#: Bytes of an Arrow batch between Spark and a Python worker; bounds the memory of both.
BATCH_BYTES = 8 << 20
#: Rows up to which a table counts as small enough to broadcast.
SMALL_ROWS = 200_000


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_BYTES: documents are long, and some are very long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, below /tmp on one machine; an error on a cluster,
    whose executors would not see each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file:///tmp/docloom-shared"
    return f"{root.rstrip('/')}/docloom-{uuid.uuid4().hex}"


def kept(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and survives the loss of executors.

    ``zstd`` is for tables of texts; for the many narrow ones its native memory costs more than it saves.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read.kept_at = path
    return read


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables from kept() that nothing will read again."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def small_or_none(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows at most ``limit`` rows, else df as it is, joined by a shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and the rows' offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def steps(batch: pa.RecordBatch, column: str = "text", step_bytes: int = STEP_BYTES):
    """Slices of the batch whose texts have about ``step_bytes`` bytes; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    _, at = text_buffers(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(at, at[start] + step_bytes, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit integers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def rows_that_stay(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of docs(doc_id, text, ...) that decisions(doc_id, text_hash, stays) keep; text_hash is xxhash64(text).

    Only the ids to drop move if a count shows that they can be broadcast, so texts stay where they are.
    Rows that share a doc_id are told apart by their texts; of rows equal in both, one stays. Other
    columns of docs may have any name.
    """
    by_id = decisions.groupBy("doc_id").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n")).where("not stays or n > 1")
    other, text_hash, stay_id, stay_hash = (free_name(docs, x) for x in ("other_id", "text_hash", "stay_id", "stay_hash"))
    by_id = kept(by_id.select(F.col("doc_id").alias(other), "stays"))
    same_id = F.col("doc_id").eqNullSafe(F.col(other))
    once = docs.join(small_or_none(by_id.select(other)), same_id, "left_anti")
    again = by_id.where("stays").select(other)
    if again.isEmpty():
        return once
    stay = decisions.where("stays").select(F.col("doc_id").alias(stay_id), F.col("text_hash").alias(stay_hash))
    rows = docs.join(again, same_id, "left_semi").withColumn(text_hash, F.xxhash64("text"))
    rows = rows.join(stay, F.col("doc_id").eqNullSafe(F.col(stay_id)) & (F.col(text_hash) == F.col(stay_hash)), "left_semi")
    return once.unionByName(rows.dropDuplicates(["doc_id", text_hash]).drop(text_hash))
