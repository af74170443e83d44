"""Streams over several files equal their batch twins; crashes leave no gaps or copies."""

import pytest
from pyspark.sql import functions as F

from vigilframe.operators import summary, threats
from vigilframe.session import fresh_path
from vigilframe.sources import readers, views
from vigilframe.streaming import jobs, sinks, tables


@pytest.fixture(scope="module")
def folder(spark, small):
    """The events as three files in arrival order."""
    path = fresh_path(spark, "events")
    events = views.table(spark, small, "events")
    for part in range(3):
        events.filter((F.col("event_id") * 3 / 1000).cast("int") == part).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture()
def stream(spark, small, folder):
    schema = views.table(spark, small, "events").schema
    return views.telemetry_from(readers.telemetry_source(spark, folder, schema, files_per_batch=1))


@pytest.fixture(scope="module")
def batch(spark, small):
    return views.telemetry(spark, small)


def test_minute_buckets(stream, batch):
    live = sinks.drain_to_table(jobs.minute_buckets(summary.with_attack(stream)), "update", ["minute"])
    got = {str(r["minute"]): (r["attack"], r["normal"]) for r in live.withColumn("minute", F.col("minute").cast("timestamp_ntz")).collect()}
    whole = summary.with_attack(batch).groupBy(threats.minute(F.col("ts")).alias("minute")).agg(
        F.count_if("attack").alias("a"), F.count_if(~F.col("attack")).alias("n"))
    assert got == {str(r["minute"]): (r["a"], r["n"]) for r in whole.collect()}


def test_late_rows_count_in_minutes_and_summary(spark):
    path = fresh_path(spark, "late-minutes")
    hours = ["05:00:00", "05:00:30", "06:00:00", "03:00:10", "03:00:20", "05:00:40"]
    events = spark.createDataFrame([(f"2024-01-01 {t}", i % 2 == 0) for i, t in enumerate(hours)], "t string, attack boolean").select(
        F.col("t").cast("timestamp_ntz").alias("ts"), "attack")
    for t in hours:  # a micro-batch each
        events.where(F.date_format("ts", "HH:mm:ss") == t).coalesce(1).write.mode("append").parquet(path)
    read = lambda: readers.telemetry_source(spark, path, events.schema, files_per_batch=1)
    minutes = sinks.drain_to_table(jobs.minute_buckets(read()), "update", ["minute"]).collect()
    assert {f"{r['minute']:%H:%M}": (r["attack"], r["normal"]) for r in minutes} == {"03:00": (1, 1), "05:00": (1, 2), "06:00": (1, 0)}
    totals = sinks.drain_to_table(jobs.sliding_summary(read()), "update", ["window_end"]).collect()
    assert len(totals) == 15 and sum(r["total_events"] for r in totals) == 5 * len(hours)


def test_threat_index(stream, batch):
    live = sinks.drain_to_table(jobs.threat_index_stream(stream), "update", ["src_ip"])
    got = {r["src_ip"]: r["threat_index"] for r in live.collect()}
    want = {r["src_ip"]: r["threat_index"] for r in threats.threat_index_final(batch, True).collect()}
    assert got == pytest.approx(want)


def test_late_events_count_in_the_index(spark):
    path = fresh_path(spark, "late")
    schema = "seq bigint, ts timestamp_ntz, src_ip string, severity string"
    rows = [(i, f"2024-01-01 {'05' if i < 3 else '03'}:00:0{i}", "a", "ALERT") for i in range(5)]
    events = spark.createDataFrame(rows, "seq bigint, ts string, src_ip string, severity string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for i in range(5):
        events.where(F.col("seq") == i).coalesce(1).write.mode("append").parquet(path)
    late = readers.telemetry_source(spark, path, spark.createDataFrame([], schema).schema, files_per_batch=1)
    live = sinks.drain_to_table(jobs.threat_index_stream(late), "update", ["src_ip"]).collect()
    want = {r["src_ip"]: r["threat_index"] for r in threats.threat_index_final(events, True).collect()}
    assert {r["src_ip"]: r["threat_index"] for r in live} == pytest.approx(want) and live[0]["events"] == 5


def test_threat_state_and_deltas(spark, stream, batch):
    path = fresh_path(spark, "states")
    states = jobs.threat_state_stream(stream)
    sinks.drain(states, sinks.changelog(path), "update")
    log = sinks.read_changelog(spark, path, states.schema)
    assert log.select("batch_id").distinct().count() == 3
    want = threats.threat_stats(batch).first()
    assert threats.stats_of_latest(sinks.latest_per_key(log, ["src_ip"])).first() == want
    moved = jobs.counter_deltas(log).agg(F.sum("active"), F.sum("blocked"), F.sum("suspicious")).first()
    assert tuple(moved) == (want["active_threats"], want["blocked_ips"], want["suspicious_ips"])


def test_transitions(spark, stream, batch):
    path, latest = fresh_path(spark, "moves"), tables.KeyedTable(spark, fresh_path(spark, "latest"), jobs.STATUSES, ["src_ip"], buckets=4)
    sinks.drain(stream, jobs.transitions_writer(path, latest))
    got = {r["seq"]: r["previous"] for r in spark.read.parquet(path).collect()}
    assert got == {r["seq"]: r["previous"] for r in threats.status_transition(batch).collect()}


def test_suppression(stream, batch):
    live = sinks.drain_to_table(jobs.suppressed_stream(threats.alert_messages(stream)))
    whole = threats.suppress_alerts(threats.alert_messages(batch))
    assert {r["seq"] for r in live.collect()} == {r["seq"] for r in whole.collect()}


def test_retention(spark, stream):
    path = fresh_path(spark, "kept")
    sinks.drain(stream.select("seq"), jobs.retention_writer(path, 70))
    assert sorted(r["seq"] for r in jobs.newest_version(spark, path).collect()) == list(range(930, 1000))


def test_restart_mid_stream(spark, stream):
    path, checkpoint = fresh_path(spark, "out"), fresh_path(spark, "checkpoint")
    write = sinks.changelog(path)

    def dies_on_second(df, batch_id):
        write(df, batch_id)
        if batch_id == 1:
            raise RuntimeError("executor lost")

    rows = stream.select("seq")
    with pytest.raises(Exception, match="executor lost"):
        sinks.drain(rows, dies_on_second, checkpoint=checkpoint)
    sinks.drain(rows, write, checkpoint=checkpoint)
    assert sorted(r["seq"] for r in spark.read.parquet(path).collect()) == list(range(1000))


def test_failed_batch_scores_zero(spark, stream):
    path = fresh_path(spark, "scores")

    def scorer(df):
        raise ValueError("no model")

    sinks.drain(stream, jobs.score_writer(scorer, path))
    rows = spark.read.schema(jobs.SCORED).parquet(path)
    assert rows.count() == 1000
    assert [tuple(r) for r in rows.select("score", "label", "error").distinct().collect()] == [(0.0, "error", "no model")]


def test_blocklist_merges_batches(spark, stream, batch):
    root = fresh_path(spark, "routed")
    sinks.drain(stream, jobs.route_writer(lambda df: df.withColumn("score", F.col("is_attack").cast("double")), root))
    got = {r["src_ip"]: r["hits"] for r in jobs.read_blocklist(spark, root).collect()}
    assert got == {r["src_ip"]: r["count"] for r in batch.filter("is_attack").groupBy("src_ip").count().collect()}
