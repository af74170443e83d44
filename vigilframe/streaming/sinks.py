"""Micro-batch sinks whose output does not change when a batch is replayed.

Every batch writes its own ``batch_id=N`` folder and overwrites it on a retry, so a crash
between write and commit leaves neither gaps nor copies. Keyed results are change logs:
the newest batch of a key wins, which :func:`latest_per_key` reads with partial aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilframe.session import fresh_path

BatchWriter = Callable[[DataFrame, int], None]


def batch_path(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def changelog(path: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> BatchWriter:
    def write(df: DataFrame, batch_id: int) -> None:
        # The checkpoint tells which batches are whole, so a folder needs no mark of it.
        out = transform(df).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", False)
        out.parquet(batch_path(path, batch_id))

    return write


def read_changelog(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    with_batch = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(with_batch).parquet(path)


def latest_per_key(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in log.columns if c not in (*keys, "batch_id")]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def drain(stream: DataFrame, write: BatchWriter, mode: str = "append", checkpoint: str | None = None):
    """Run a stream over all that is available, then stop; returns the finished query."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", checkpoint or fresh_path(spark, "checkpoint"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def kept(rows: DataFrame, path: str) -> DataFrame:
    """Rows written once and read back, so that what follows sees the same."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def follow(stream: DataFrame, write: BatchWriter, mode: str = "append", checkpoint: str | None = None):
    """Run a stream, batch after batch, until nothing new is there; for sources that admit a part at a time."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", checkpoint or fresh_path(stream.sparkSession, "checkpoint")).start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query


def drain_to_table(stream: DataFrame, mode: str = "append", keys: Sequence[str] = (), label: str = "table") -> DataFrame:
    """Drain into a change log and read it back (newest row per key when keys are given)."""
    path = fresh_path(stream.sparkSession, label)
    drain(stream, changelog(path), mode)
    log = read_changelog(stream.sparkSession, path, stream.schema)
    return latest_per_key(log, keys) if keys else log.drop("batch_id")
