"""Tables that micro-batches maintain, so that a replayed batch leaves them as one run would.

What batch N writes depends only on what batch N - 1 left, and goes to folders of N, which a
replay overwrites.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilframe.operators import threats
from vigilframe.streaming import sinks


def bucket_of(keys: Iterable[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class KeyedTable:
    """One row per key in hash buckets; a batch rewrites only the buckets its keys fall in.

    data/version=N/bucket=b holds what batch N made of bucket b; manifest/version=N says which
    version of each bucket is current after batch N. A crash before the manifest is written
    leaves the table of batch N - 1, as nothing of it has been overwritten.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, keys, buckets

    def manifest(self, batch_id: int) -> dict[int, int]:
        if batch_id < 0:
            return {}
        rows = self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/manifest/version={batch_id}")
        return {r["bucket"]: r["version"] for r in rows.collect()}  # at most a row for each bucket

    def read(self, batch_id: int, only: Iterable[int] | None = None) -> DataFrame:
        """The rows after a batch, of all buckets or of some."""
        held = self.manifest(batch_id)
        wanted = held if only is None else [b for b in only if b in held]
        paths = [f"{self.path}/data/version={held[b]}/bucket={b}" for b in wanted]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, changes: DataFrame) -> list[int]:
        return [r["b"] for r in changes.select(bucket_of(self.keys, self.buckets).alias("b")).distinct().collect()]

    def upsert(self, changes: DataFrame, batch_id: int) -> None:
        """Puts one row per key in the place of the key's row."""
        touched, held = self.touched(changes), self.manifest(batch_id - 1)
        old = self.read(batch_id - 1, touched).join(changes.select(*self.keys), self.keys, "left_anti")
        rows = old.unionByName(changes.select(*self.schema.names)).withColumn("bucket", bucket_of(self.keys, self.buckets))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={batch_id}")
        current = sorted((held | {b: batch_id for b in touched}).items())
        self.spark.createDataFrame(current, "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/manifest/version={batch_id}")


# ---------------------------------------------------------------- ids

HASHES = 4


def bloom_places(hashes: np.ndarray, bits: int) -> np.ndarray:
    low, high = hashes.view(np.uint64) & np.uint64(0xFFFFFFFF), hashes.view(np.uint64) >> np.uint64(32)
    return (low + np.arange(HASHES, dtype=np.uint64)[:, None] * (high | np.uint64(1))) & np.uint64(bits - 1)


def bloom_of(hashes: np.ndarray) -> bytes:
    """About one id in 100 that is not in the filter passes it."""
    flags = np.zeros(max(64, 1 << (10 * len(hashes) - 1).bit_length()), bool)
    flags[bloom_places(hashes, len(flags)).reshape(-1).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def may_hold(bloom: bytes, hashes: np.ndarray) -> np.ndarray:
    flags = np.unpackbits(np.frombuffer(bloom, np.uint8)).astype(bool)
    return flags[bloom_places(hashes, len(flags)).astype(np.int64)].all(axis=0)


class SeenIds:
    """All ids of earlier batches, exactly, however late a repeat comes.

    Each batch leaves its new ids in hash buckets, with a Bloom filter for each bucket. A batch
    probes the filters of its buckets first; only ids that pass are joined with the ids on disk,
    and of these only touched buckets are read. Every `merge_every` batches the ids so far become
    one base, so that the number of files and filters stays bounded.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, merge_every: int = 20):
        self.spark, self.path, self.buckets, self.merge_every = spark, path, buckets, merge_every

    def parts(self, batch_id: int) -> list[str]:
        """The folders that hold what was seen before a batch."""
        base = batch_id // self.merge_every * self.merge_every
        return [f"base={base}"] * (base > 0) + [f"batch={n}" for n in range(base, batch_id)]

    def ids(self, batch_id: int, only: list[int] | None = None) -> DataFrame:
        empty = self.spark.createDataFrame([], "id string, h long, bucket int")
        out = empty
        for part in self.parts(batch_id):
            rows = self.spark.read.option("basePath", f"{self.path}/ids/{part}").schema("id string, h long, bucket int").parquet(f"{self.path}/ids/{part}")
            out = out.unionByName(rows if only is None else rows.where(F.col("bucket").isin(only)))
        return out

    def filters(self, batch_id: int) -> DataFrame:
        out = self.spark.createDataFrame([], "bucket int, bloom binary")
        for part in self.parts(batch_id):
            out = out.unionByName(self.spark.read.schema("bucket int, bloom binary").parquet(f"{self.path}/filters/{part}"))
        return out

    def keyed(self, ids: DataFrame) -> DataFrame:
        return ids.select("id", F.xxhash64("id").alias("h"), bucket_of(["id"], self.buckets).alias("bucket"))

    def fresh(self, ids: DataFrame, batch_id: int) -> DataFrame:
        """The distinct ids (id) of a batch that no earlier batch had."""
        ids = self.keyed(ids)
        if not self.parts(batch_id):
            return ids.select("id")

        def probe(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            hashes, hit = rows["h"].to_numpy(), np.zeros(len(rows), bool)
            for bloom in filters["bloom"]:
                hit |= may_hold(bloom, hashes)
            return pd.DataFrame({"id": rows["id"], "bucket": rows["bucket"], "hit": hit})

        probed = ids.groupBy("bucket").cogroup(self.filters(batch_id).groupBy("bucket")).applyInPandas(
            probe, "id string, bucket int, hit boolean").persist()
        try:
            hits = probed.where("hit")
            touched = [r["bucket"] for r in hits.select("bucket").distinct().collect()]  # at most all buckets
            known = hits.join(self.ids(batch_id, touched).select("id"), "id", "left_semi").select("id")
            fresh = probed.join(known, "id", "left_anti").select("id")
            return sinks.kept(fresh, f"{self.path}/fresh/batch={batch_id}")
        finally:
            probed.unpersist()

    def add(self, ids: DataFrame, batch_id: int) -> None:
        self.write(self.keyed(ids), f"batch={batch_id}")
        if (batch_id + 1) % self.merge_every == 0:
            self.write(self.ids(batch_id).unionByName(self.spark.read.schema("id string, h long, bucket int").parquet(f"{self.path}/ids/batch={batch_id}")),
                       f"base={batch_id + 1}")

    def write(self, ids: DataFrame, part: str) -> None:
        ids.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/ids/{part}")
        written = self.spark.read.schema("id string, h long, bucket int").parquet(f"{self.path}/ids/{part}")
        make = lambda pdf: pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "bloom": [bloom_of(pdf["h"].to_numpy())]})
        written.select("bucket", "h").groupBy("bucket").applyInPandas(make, "bucket int, bloom binary").write.mode("overwrite").parquet(
            f"{self.path}/filters/{part}")


def first_of_id_writer(seen: SeenIds, path: str, order: str) -> sinks.BatchWriter:
    """Of each id the first row that comes, of those of one micro-batch the first by `order`.

    Repeats are dropped however late they come; a late row whose id is new stays. Rows without an
    id can't repeat one and all stay.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        rest = [c for c in df.columns if c != "id"]
        first = df.where("id is not null").groupBy("id").agg(F.min_by(F.struct(*rest), order).alias("row"))
        fresh = seen.fresh(first.select("id"), batch_id)
        rows = first.join(fresh, "id").select("id", *[F.col(f"row.{c}").alias(c) for c in rest])
        rows.unionByName(df.where("id is null").select("id", *rest)).write.mode("overwrite").parquet(sinks.batch_path(path, batch_id))
        seen.add(spark_ids(seen.spark, path, batch_id, df.schema), batch_id)

    return write


def spark_ids(spark: SparkSession, path: str, batch_id: int, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(sinks.batch_path(path, batch_id)).where("id is not null").select("id")


# ---------------------------------------------------------------- minutes with late rows

MINUTE = "minute timestamp_ntz, attack long, normal long"


class MinuteTotals:
    """Minute counts whose open part is bounded by the lateness, and which late rows still reach.

    The mark is the newest time of earlier batches less the lateness. Minutes that end after it
    are open: each batch writes them anew with its rows added. A minute that the mark passes is
    written once to the closed table. Rows behind the mark go, counted, to the table of late
    rows; totals are the sums of all three.
    """

    def __init__(self, spark: SparkSession, path: str, lateness: str = "10 minutes"):
        self.spark, self.path, self.lateness = spark, path, lateness

    def part(self, name: str, batch_id: int) -> DataFrame:
        return self.spark.read.schema(MINUTE).parquet(sinks.batch_path(f"{self.path}/{name}", batch_id))

    def newest(self, batch_id: int) -> DataFrame:
        return self.spark.read.schema("newest timestamp_ntz").parquet(sinks.batch_path(f"{self.path}/newest", batch_id))

    def write(self, df: DataFrame, batch_id: int) -> None:
        """For foreachBatch: df has ts and attack."""
        rows = df.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "attack")
        counts = rows.groupBy(threats.minute(F.col("ts")).alias("minute")).agg(
            F.count_if("attack").alias("attack"), F.count_if(~F.col("attack")).alias("normal"), F.max("ts").alias("newest")).persist()
        try:
            before = self.newest(batch_id - 1) if batch_id else self.spark.createDataFrame([], "newest timestamp_ntz")
            after = before.unionByName(counts.select("newest")).agg(F.max("newest").alias("newest"))
            after.write.mode("overwrite").parquet(sinks.batch_path(f"{self.path}/newest", batch_id))
            mark, next_mark = (f.agg(F.max("newest")).scalar() - F.expr(f"interval {self.lateness}") for f in (before, self.newest(batch_id)))
            end = F.col("minute") + F.expr("interval 1 minute")
            late = F.coalesce(end <= mark, F.lit(False))
            fields = ["minute", "attack", "normal"]
            self.put("late", counts.where(late).select(*fields), batch_id)
            held = counts.where(~late).select(*fields)
            if batch_id:
                held = held.unionByName(self.part("open", batch_id - 1))
            held = held.groupBy("minute").agg(F.sum("attack").alias("attack"), F.sum("normal").alias("normal"))
            passed = F.coalesce(end <= next_mark, F.lit(False))
            self.put("closed", held.where(passed), batch_id)
            self.put("open", held.where(~passed), batch_id)
        finally:
            counts.unpersist()

    def put(self, name: str, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(sinks.batch_path(f"{self.path}/{name}", batch_id))

    def totals(self) -> DataFrame:
        """(minute, attack, normal) of all rows so far, late ones included."""
        every = lambda name: sinks.read_changelog(self.spark, f"{self.path}/{name}", T._parse_datatype_string(MINUTE))
        opened = every("open")
        last = opened.where(F.col("batch_id") == opened_batch(self.spark, self.path))
        rows = every("closed").unionByName(every("late")).unionByName(last)
        return rows.groupBy("minute").agg(F.sum("attack").alias("attack"), F.sum("normal").alias("normal"))


def opened_batch(spark: SparkSession, path: str):
    """The newest batch; every batch leaves its newest time."""
    log = sinks.read_changelog(spark, f"{path}/newest", T._parse_datatype_string("newest timestamp_ntz"))
    return log.agg(F.max("batch_id")).scalar()


def trailing_summary(totals: DataFrame, minutes: int = 5) -> DataFrame:
    """Totals and attack rate of the trailing window at the end of each minute, from minute counts."""
    ends = F.explode(F.sequence(F.lit(1), F.lit(minutes)))
    wide = totals.select("attack", "normal", (F.col("minute")).alias("minute"), ends.alias("k")).select(
        "attack", "normal", (F.col("minute") + F.make_dt_interval(mins=F.col("k"))).alias("window_end"))
    return wide.groupBy("window_end").agg(F.sum(F.col("attack") + F.col("normal")).alias("total_events"), F.sum("attack").alias("attacks")).select(
        "window_end", "total_events", F.round(F.col("attacks") / minutes, 2).alias("attack_rate"))
