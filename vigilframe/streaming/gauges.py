"""Gauges of running streams: latency quantiles from a mergeable sketch, and the backlog of a consumer."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilframe.operators import threats
from vigilframe.sources.following import opened
from vigilframe.streaming import sinks
from vigilframe.streaming.jobs import with_event_time

KEPT_BITS = 8  # leading bits of a latency that its cell keeps: at most 1 part in 128 is lost
QUANTILES = {"p50": 500, "p95": 950, "p99": 990}  # in thousandths
GAUGE = "offered long, processed long, backlog long"


def cell_of(ms: Column) -> Column:
    """The latency with all but its leading KEPT_BITS bits cleared; below 256 ms nothing is lost, a clock set back is 0."""
    ms = F.greatest(ms, F.lit(0))
    shift = F.greatest(F.length(F.bin(ms)) - KEPT_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", ms, shift), shift).cast("long")


def latency_cells(stream: DataFrame, event_ts: str, processed_ts: str, lateness: str | None = None) -> DataFrame:
    """Counts per minute of the event and latency cell, as built-in streaming state.

    Cells add up, so that counts of several streams or days merge by a sum; a minute has at most
    128 of them for each doubling of the latency. Rows are not kept. Only with `lateness` are
    minutes dropped from the state, and only then are later rows left out.
    """
    ms = F.unix_millis(F.col(processed_ts).cast("timestamp")) - F.unix_millis(F.col(event_ts).cast("timestamp"))
    rows = stream.select(F.col(event_ts).alias("ts"), cell_of(ms).alias("cell"))
    counts = with_event_time(rows, lateness=lateness).groupBy(F.window("ts", "1 minute").alias("w"), "cell").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("minute"), "cell", "n")


def latency_quantiles(cells: DataFrame) -> DataFrame:
    """(minute, events, p50, p95, p99): the cell of the value of rank ceil(q * events), at most 1/128 below that value."""
    upto = Window.partitionBy("minute").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("minute")
    rows = cells.groupBy("minute", "cell").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(upto)).withColumn("events", F.sum("n").over(whole))
    at = lambda q: F.min(F.when(F.col("upto") * 1000 >= F.col("events") * q, F.col("cell")))
    return rows.groupBy(F.col("minute").cast("timestamp_ntz").alias("minute")).agg(
        F.max("events").alias("events"), *[at(q).alias(name) for name, q in QUANTILES.items()])


class Backlog:
    """Records offered to a consumer and not yet processed by it, noted with each of its micro-batches.

    `offered` gives the records there are as a frame, which is counted; from Parquet files that
    reads their footers only, and not again before other files are there. A replayed batch overwrites its note,
    a small file that the driver writes: `path` has to be one that it reaches.
    """

    def __init__(self, spark: SparkSession, path: str, offered):
        self.spark, self.path, self.offered = spark, path, offered
        self.last = (-1, 0)  # newest note of this run; after a restart it is read
        self.files, self.there = [], 0

    def count_offered(self) -> int:
        frame = self.offered()
        files = sorted(frame.inputFiles())
        if not files or files != self.files:  # no files: what else the frame reads may have grown
            self.there, self.files = frame.count(), files
        return self.there

    def processed(self, batch_id: int) -> int:
        if batch_id < 0:
            return 0
        if batch_id == self.last[0]:
            return self.last[1]
        return self.spark.read.schema(GAUGE).parquet(sinks.batch_path(self.path, batch_id)).first()["processed"]

    def noted(self, write: sinks.BatchWriter, once: bool = False) -> sinks.BatchWriter:
        """A writer that also notes the gauge.

        `once`: the write reads the whole batch in a single action without a shuffle, as a change
        log does, so that rows are counted as they pass and the batch costs no other job. Without
        it the batch is held and counted apart, whatever the write does with it.
        """

        def run(df: DataFrame, batch_id: int) -> None:
            if once:
                seen = Observation()
                write(df.observe(seen, F.count(F.lit(1)).alias("n")), batch_id)
                n = seen.get["n"]
            else:
                df = df.persist()  # the source is read once for both
                try:
                    write(df, batch_id)
                    n = df.count()
                finally:
                    df.unpersist()
            offered, done = self.count_offered(), self.processed(batch_id - 1) + n
            self.keep({"offered": offered, "processed": done, "backlog": offered - done}, batch_id)
            self.last = (batch_id, done)

        return run

    def keep(self, note: dict[str, int], batch_id: int) -> None:
        """The note's folder holds one file, which is there as a whole or not at all."""
        fs, folder = opened(sinks.batch_path(self.path, batch_id))
        fs.create_dir(folder)
        fs.delete_dir_contents(folder)
        pq.write_table(pa.table({c: pa.array([v], pa.int64()) for c, v in note.items()}), f"{folder}/.note", filesystem=fs)
        fs.move(f"{folder}/.note", f"{folder}/note.parquet")

    def history(self) -> DataFrame:
        return sinks.read_changelog(self.spark, self.path, T._parse_datatype_string(GAUGE))

    def now(self) -> int:
        """The backlog at this moment, also while the consumer stands still."""
        return self.count_offered() - (self.history().agg(F.max("processed")).first()[0] or 0)
