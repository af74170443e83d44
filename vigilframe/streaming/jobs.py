"""Streaming jobs over telemetry and log lines."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vigilframe.functions import bands
from vigilframe.operators import ingest, logs, ordering, threats
from vigilframe.operators.logs import blocklist
from vigilframe.session import ROCKSDB_PROVIDER, fresh_path
from vigilframe.streaming import sinks, tables

LATENESS = "10 minutes"  # default where a state expires: rows later than that are left out


def use_rocksdb(spark: SparkSession) -> None:
    """Keep large keyed state off the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)


def with_event_time(df: DataFrame, ts: str = "ts", lateness: str | None = LATENESS) -> DataFrame:
    """Watermarks need a zoned timestamp; lateness None sets no watermark."""
    zoned = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return zoned.withWatermark(ts, lateness) if lateness else zoned


def ingest_writer(accepted_path: str, rejected_path: str, producer: str) -> sinks.BatchWriter:
    """Validate, drop pulses, fill defaults; accepted events and rejects go to two tables."""

    def write(df: DataFrame, batch_id: int) -> None:
        checked = ingest.validate_events(ingest.drop_heartbeats(df, producer=producer)).persist()
        try:
            good = ingest.default_event_fields(checked.filter("accepted"), F.current_timestamp().cast("timestamp_ntz"))
            good.drop("errors", "accepted").write.mode("overwrite").parquet(sinks.batch_path(accepted_path, batch_id))
            checked.filter("not accepted").write.mode("overwrite").parquet(sinks.batch_path(rejected_path, batch_id))
        finally:
            checked.unpersist()

    return write


def packets_by_source(stream: DataFrame) -> DataFrame:
    """Running totals per source; sums over it give the overall counters."""
    attack = F.col("category") == "attack"
    return stream.groupBy(F.coalesce("src_ip", F.lit("")).alias("src_ip")).agg(
        F.count("*").alias("total"), F.count_if(attack).alias("attacks")
    )


def totals_of_sources(latest: DataFrame) -> DataFrame:
    return latest.agg(
        F.sum("total").alias("total_packets"), F.sum("attacks").alias("attack_packets"),
        (F.sum("total") - F.sum("attacks")).alias("normal_packets"),
        F.count_if((F.col("src_ip") != "") & (F.col("attacks") > 0)).alias("unique_ips_blocked"),
    )


def minute_buckets(stream: DataFrame, lateness: str | None = None) -> DataFrame:
    """Tumbling minute counts of attack and other events, late rows included.

    The state holds one row per minute. Only with ``lateness`` are minutes dropped from it, and
    only then are rows later than that left out.
    """
    windowed = with_event_time(stream, lateness=lateness).groupBy(F.window("ts", "1 minute").alias("w"))
    counts = windowed.agg(F.count_if("attack").alias("attack"), F.count_if(~F.col("attack")).alias("normal"))
    return counts.select(F.col("w.start").alias("minute"), "attack", "normal")


def sliding_summary(stream: DataFrame, minutes: int = 5, lateness: str | None = None) -> DataFrame:
    """Totals and attack rate of the trailing window, refreshed every minute; late rows as in minute_buckets."""
    windowed = with_event_time(stream, lateness=lateness).groupBy(F.window("ts", f"{minutes} minutes", "1 minute").alias("w"))
    return windowed.agg(F.count("*").alias("total_events"), F.count_if("attack").alias("attacks")).select(
        F.col("w.end").alias("window_end"), "total_events", F.round(F.col("attacks") / minutes, 2).alias("attack_rate")
    )


# --- threat index ----------------------------------------------------------------------------

def _newest_per_source(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per Arrow batch, only the newest rows of a source matter: shrink before the shuffle."""
    for pdf in batches:
        pdf = pdf.sort_values("seq")
        pdf["events"] = pdf.groupby("src_ip")["seq"].transform("size")
        newest = pdf.groupby("src_ip").tail(ordering.REACH).copy()
        first = ~newest.duplicated("src_ip")
        newest["events"] = newest["events"].where(first, 0).astype("int64")
        yield newest


INDEX_STATE = T.StructType([T.StructField("recent", T.StringType()), T.StructField("events", T.LongType())])
INDEX_SCHEMA = "src_ip string, threat_index double, events bigint"


def _advance_index(key, batches: Iterator[pd.DataFrame], state: GroupState, idle_ms: int | None) -> Iterator[pd.DataFrame]:
    """Keep the newest contributions of a source; its index is their decayed sum."""
    if state.hasTimedOut:
        state.remove()
        return
    held = state.get if state.exists else ("[]", 0)
    recent, events = [tuple(x) for x in json.loads(held[0])], int(held[1])
    newest_ms = state.getCurrentWatermarkMs() if idle_ms else 0
    for pdf in batches:
        events += int(pdf["events"].sum())
        newest_ms = max(newest_ms, int(pdf["ts"].max().timestamp() * 1000))
        recent = sorted(recent + list(zip(pdf["seq"].tolist(), pdf["w"].tolist())))[-ordering.REACH:]
    state.update((json.dumps(recent), events))
    if idle_ms:
        state.setTimeoutTimestamp(newest_ms + idle_ms)
    index = sum(w * 0.5**age for age, (_, w) in enumerate(reversed(recent)))
    yield pd.DataFrame({"src_ip": [key[0]], "threat_index": [float(index)], "events": [events]})


def threat_index_stream(stream: DataFrame, idle_ms: int | None = None, lateness: str = LATENESS) -> DataFrame:
    """The index of every source that changed in a micro-batch, late rows included.

    Only with ``idle_ms`` does a source lose its state, that long after its last event, and only
    then are rows later than ``lateness`` left out. That timeout runs on event time: a
    processing-time one would keep a run over all available data from ever ending.
    """
    rows = stream.select("src_ip", "seq", F.col("ts").cast("timestamp").alias("ts"), threats.index_contribution(F.col("severity")).alias("w"))
    reduced = rows.mapInPandas(_newest_per_source, "src_ip string, seq bigint, ts timestamp, w double, events bigint")
    step = lambda key, batches, state: _advance_index(key, batches, state, idle_ms)
    rows = with_event_time(reduced, lateness=lateness) if idle_ms else reduced
    timeout = GroupStateTimeout.EventTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy("src_ip").applyInPandasWithState(step, INDEX_SCHEMA, INDEX_STATE, "update", timeout)


# --- threat state ----------------------------------------------------------------------------

def threat_state_stream(stream: DataFrame) -> DataFrame:
    """Latest status per address as built-in streaming state (combined map-side)."""
    return threats.latest_status(stream)


def counter_deltas(log: DataFrame) -> DataFrame:
    """+1/-1 changes of the counters from a change log of statuses, per batch."""
    from pyspark.sql.window import Window

    previous = F.lag("status").over(Window.partitionBy("src_ip").orderBy("batch_id"))
    steps = log.withColumn("previous", previous).filter(~F.col("previous").eqNullSafe(F.col("status")))

    def moved(flag) -> object:
        return F.sum(flag(F.col("status")).cast("int") - F.coalesce(flag(F.col("previous")).cast("int"), F.lit(0)))

    return steps.groupBy("batch_id").agg(
        moved(lambda s: s == "Active").alias("active"), moved(lambda s: s == "Blocked").alias("blocked"),
        moved(lambda s: s != "Blocked").alias("suspicious"),
    )


STATUSES = T.StructType([T.StructField("src_ip", T.StringType()), T.StructField("status", T.StringType())])


def transitions_writer(path: str, latest: tables.KeyedTable) -> sinks.BatchWriter:
    """Row-level status transitions; the status before a batch comes from the table that the batches maintain."""

    def write(df: DataFrame, batch_id: int) -> None:
        rows = df.select("seq", "src_ip", "status").persist()
        try:
            newest = rows.groupBy("src_ip").agg(F.max_by("status", "seq").alias("status"))
            known = latest.read(batch_id - 1, latest.touched(newest)).select("src_ip", F.col("status").alias("_held"))
            moves = threats.status_transition(rows).join(known, "src_ip", "left")
            moves = moves.withColumn("previous", F.coalesce("previous", "_held")).drop("_held")
            moves.write.mode("overwrite").parquet(sinks.batch_path(path, batch_id))
            latest.upsert(newest, batch_id)
        finally:
            rows.unpersist()

    return write


# --- scoring ---------------------------------------------------------------------------------

Scorer = Callable[[DataFrame], DataFrame]
SCORED = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("score", T.DoubleType()),
    T.StructField("label", T.StringType()), T.StructField("error", T.StringType()),
])


def score_writer(scorer: Scorer, path: str) -> sinks.BatchWriter:
    """Score a micro-batch; when scoring fails, every row of it gets score 0 and the message."""

    def write(df: DataFrame, batch_id: int) -> None:
        target = sinks.batch_path(path, batch_id)
        try:
            scored = scorer(df).select("seq", "score", bands.anomaly_label(F.col("score")).alias("label"), F.lit(None).cast("string").alias("error"))
            scored.write.mode("overwrite").parquet(target)
        except Exception as exc:
            failed = df.select("seq", F.lit(0.0).alias("score"), F.lit("error").alias("label"), F.lit(str(exc)).alias("error"))
            failed.write.mode("overwrite").parquet(target)

    return write


def route_writer(scorer: Scorer, root: str) -> sinks.BatchWriter:
    """Score, then route: attack and normal tables, log lines, and block-list parts."""
    from vigilframe.functions.logtext import detection_line

    def write(df: DataFrame, batch_id: int) -> None:
        scored = scorer(df).withColumn("attack", F.col("score") >= 0.5).persist()
        try:
            for name, part in (("attacks", scored.filter("attack")), ("normal", scored.filter("not attack"))):
                part.write.mode("overwrite").parquet(sinks.batch_path(f"{root}/{name}", batch_id))
            line = detection_line(F.col("ts"), F.col("attack"), F.col("src_ip"), F.col("src_port"), F.col("dst_port"))
            scored.select(line.alias("line")).write.mode("overwrite").text(sinks.batch_path(f"{root}/log", batch_id))
            blocklist(scored).write.mode("overwrite").parquet(sinks.batch_path(f"{root}/blocklist", batch_id))
        finally:
            scored.unpersist()

    return write


def read_blocklist(spark: SparkSession, root: str) -> DataFrame:
    """The block list: per-batch parts merged by source."""
    parts = spark.read.parquet(f"{root}/blocklist")
    return parts.groupBy("src_ip").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("hits").alias("hits")
    )


# --- retention, feed, alerts -----------------------------------------------------------------

def retention_writer(path: str, keep: int) -> sinks.BatchWriter:
    """Newest ``keep`` events; each batch writes a new version from the one before."""

    def write(df: DataFrame, batch_id: int) -> None:
        rows = df if batch_id == 0 else df.unionByName(df.sparkSession.read.parquet(sinks.batch_path(path, batch_id - 1)))
        ordering.newest_n(rows, keep).write.mode("overwrite").parquet(sinks.batch_path(path, batch_id))

    return write


def newest_version(spark: SparkSession, path: str) -> DataFrame:
    versions = spark.read.parquet(path)
    return versions.filter(F.col("batch_id") == versions.agg(F.max("batch_id")).scalar()).drop("batch_id")


def live_feed(history: DataFrame, stream: DataFrame, replay: int = 50) -> DataFrame:
    """The last events of the history, then everything new."""
    feed = fresh_path(history.sparkSession, "feed")
    ordering.newest_n_in_order(history, replay).write.parquet(f"{feed}/batch_id=-1")
    sinks.drain(stream, sinks.changelog(feed))
    return sinks.read_changelog(history.sparkSession, feed, stream.schema).drop("batch_id")


ALERT_STATE = T.StructType([T.StructField("heard", T.StringType())])


def _suppress(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values("seq")
    mask, end = threats.suppression_rule(rows, json.loads(state.get[0]) if state.exists else {})
    state.update((json.dumps(end),))
    yield rows.loc[mask, ["seq", "src_ip", "level", "identity", "ms"]]


def _first_ticks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of equal messages in one millisecond only the first can pass."""
    for pdf in batches:
        yield pdf.sort_values("seq").drop_duplicates(["src_ip", "level", "identity", "ms"])


def suppressed_stream(messages: DataFrame) -> DataFrame:
    """Alert suppression with the per-source memory as streaming state.

    A micro-batch holds a bounded number of files, so a hot source's share of it is bounded.
    """
    schema = "seq bigint, src_ip string, level string, identity string, ms bigint"
    thinned = messages.mapInPandas(_first_ticks, messages.schema)
    return thinned.groupBy("src_ip").applyInPandasWithState(_suppress, schema, ALERT_STATE, "append", GroupStateTimeout.NoTimeout)


def log_messages(stream: DataFrame, as_of) -> DataFrame:
    """Parsed lines as the messages a log follower receives."""
    parsed = logs.parse_lines(stream, as_of)
    return parsed.select(F.col("ts").alias("timestamp"), "line", F.col("category").alias("type"))


def rows_per_batch(log: DataFrame) -> DataFrame:
    """Rows of every micro-batch, counted in the change log itself: progress reports are forgotten."""
    return log.groupBy("batch_id").agg(F.count("*").alias("input_rows"))


def detection_latency(df: DataFrame, event_ts: str, processed_ts: str) -> DataFrame:
    """Milliseconds from event to processing: median, p95 and p99 per minute of the event."""
    ms = F.unix_millis(F.col(processed_ts).cast("timestamp")) - F.unix_millis(F.col(event_ts).cast("timestamp"))
    # Whole milliseconds keep the exact percentile's value table small.
    q = F.percentile(ms, [0.5, 0.95, 0.99])
    per = df.groupBy(threats.minute(F.col(event_ts)).alias("minute")).agg(q.alias("q"), F.count("*").alias("events"))
    return per.select("minute", "events", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"))
