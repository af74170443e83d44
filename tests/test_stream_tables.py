"""Tables kept by micro-batches, scoring in groups, and status deltas: late rows, repeats, failures, replays, expiry."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilframe.operators import summary, threats
from vigilframe.session import fresh_path
from vigilframe.sources import readers, views
from vigilframe.streaming import gauges, jobs, scoring, sinks, states, tables


def arriving(spark, batches, schema):
    """A stream whose micro-batches are the given lists of rows."""
    path = fresh_path(spark, "arriving")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return readers.telemetry_source(spark, path, spark.createDataFrame([], schema).schema, files_per_batch=1)


def dies_on(write, batch):
    def run(df, batch_id):
        write(df, batch_id)
        if batch_id == batch:
            raise RuntimeError("lost before commit")

    return run


def drained(stream, write, crash=None):
    state = fresh_path(stream.sparkSession, "checkpoint")
    if crash is not None:
        with pytest.raises(Exception, match="lost before commit"):
            sinks.drain(stream, dies_on(write, crash), checkpoint=state)
    sinks.drain(stream, write, checkpoint=state)


# ---------------------------------------------------------------- ids

@pytest.mark.parametrize("merge_every", [2, 20])
def test_ids_count_once_however_late(spark, merge_every):
    draw = random.Random(merge_every)
    seq, batches = 0, []
    for n in range(5):
        rows = []
        for _ in range(60):
            rows.append((draw.choice([f"id{draw.randint(0, 120)}", f"only{n}-{draw.randint(0, 9)}", None]), seq))
            seq += 1
        batches.append(rows)
    path, seen = fresh_path(spark, "firsts"), tables.SeenIds(spark, fresh_path(spark, "seen"), buckets=4, merge_every=merge_every)
    drained(arriving(spark, batches, "id string, seq long"), tables.first_of_id_writer(seen, path, "seq"), crash=3)
    got = sorted((r["id"] or "", r["seq"]) for r in spark.read.parquet(path).collect())
    first = {}
    for rows in batches:
        for i, s in rows:
            if i is not None:
                first.setdefault(i, s)
    assert got == sorted([*first.items(), *(("", s) for rows in batches for i, s in rows if i is None)])
    assert len(seen.parts(5)) <= merge_every + 1


def test_bloom_filters_hold_what_they_were_made_of():
    hashes = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 4000)
    bloom = tables.bloom_of(hashes[:2000])
    assert tables.may_hold(bloom, hashes[:2000]).all() and tables.may_hold(bloom, hashes[2000:]).mean() < 0.05


# ---------------------------------------------------------------- keyed table

KEYED = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])


def test_keyed_table_rewrites_touched_buckets_only(spark):
    table = tables.KeyedTable(spark, fresh_path(spark, "keyed"), KEYED, ["k"], buckets=8)
    put = lambda rows, n: table.upsert(spark.createDataFrame(rows, KEYED), n)
    put([(k, "old") for k in range(50)], 0)
    put([(7, "new"), (1000, "new")], 1)
    want = {**{k: "old" for k in range(50)}, 7: "new", 1000: "new"}
    assert {r["k"]: r["v"] for r in table.read(1).collect()} == want
    assert sum(v == 1 for v in table.manifest(1).values()) <= 2 and len(table.manifest(1)) >= 7
    # A batch that dies after the data and before the manifest leaves the table as it was; its replay repairs it.
    real, table.spark = table.spark, None
    with pytest.raises(AttributeError):
        table.upsert(spark.createDataFrame([(3, "lost")], KEYED), 2)
    table.spark = real
    assert {r["k"]: r["v"] for r in table.read(1).collect()} == want
    put([(3, "replayed")], 2)
    put([(3, "replayed")], 2)
    assert {r["k"]: r["v"] for r in table.read(2).collect()} == {**want, 3: "replayed"}


# ---------------------------------------------------------------- minutes

def test_late_rows_reach_the_minutes(spark):
    times = ["05:00:00", "05:00:30", "06:00:00", "03:00:10", "05:55:00", "03:00:20", "06:30:00", "05:00:40", "06:25:59"]
    batches = [[(f"2024-01-01 {t}", i % 2 == 0)] for i, t in enumerate(times)]
    stream = arriving(spark, batches, "t string, attack boolean").select(F.col("t").cast("timestamp_ntz").alias("ts"), "attack")
    minutes = tables.MinuteTotals(spark, fresh_path(spark, "minutes"), "10 minutes")
    drained(stream, minutes.write, crash=5)
    want = Counter((t[:5], i % 2 == 0) for i, t in enumerate(times))
    got = {f"{r['minute']:%H:%M}": (r["attack"], r["normal"]) for r in minutes.totals().collect()}
    assert got == {m: (want[(m, True)], want[(m, False)]) for m in {t[:5] for t in times}}
    part = lambda name: sinks.read_changelog(spark, f"{minutes.path}/{name}", T._parse_datatype_string(tables.MINUTE))
    assert sorted(f"{r['minute']:%H:%M}" for r in part("late").collect()) == ["03:00", "03:00", "05:00"]
    assert sorted(f"{r['minute']:%H:%M}" for r in part("open").where("batch_id = 8").collect()) == ["06:25", "06:30"]  # bounded by the lateness
    assert sum(r["total_events"] for r in tables.trailing_summary(minutes.totals()).collect()) == 5 * len(times)


def test_minutes_equal_the_batch_twin(spark, small):
    batch = summary.with_attack(views.telemetry(spark, small))
    path = fresh_path(spark, "three")
    for part in range(3):
        batch.select("seq", "ts", "attack").where(F.col("seq") % 3 == part).coalesce(1).write.mode("append").parquet(path)  # all minutes in each part
    minutes = tables.MinuteTotals(spark, fresh_path(spark, "minutes"), "1 minute")
    sinks.drain(readers.telemetry_source(spark, path, spark.read.parquet(path).schema, files_per_batch=1), minutes.write)
    whole = batch.groupBy(threats.minute(F.col("ts")).alias("minute")).agg(F.count_if("attack").alias("a"), F.count_if(~F.col("attack")).alias("n"))
    assert {r["minute"]: (r["attack"], r["normal"]) for r in minutes.totals().collect()} == {r["minute"]: (r["a"], r["n"]) for r in whole.collect()}


# ---------------------------------------------------------------- scoring

def test_a_poison_row_spoils_its_group_only(spark):
    rows = [(i, "0.5" if i != 500 else "not a number", None if i % 3 else "1") for i in range(1000)]
    stream = arriving(spark, [rows[:400], rows[400:]], "seq long, a string, b string")
    got = sinks.drain_to_table(scoring.scored_in_groups(stream, ["a", "b"]))
    bad = got.where("label = 'error'").collect()
    assert 1 <= len(bad) <= 32 and 500 in {r["seq"] for r in bad}
    assert {(r["score"], r["error"]) for r in bad} == {(0.0, "could not convert string to float: 'not a number'")}
    good = got.where("label <> 'error'").collect()
    assert len(good) + len(bad) == 1000
    assert all(r["score"] == pytest.approx(np.tanh((0.5 + (0 if r["seq"] % 3 else 1)) / (2 + 1e-6))) and r["error"] is None for r in good)


def test_a_scorer_that_gives_too_few_scores_is_an_error(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(5)], "seq long, a double").coalesce(1)
    got = scoring.scored_in_groups(rows, ["a"], lambda v: [0.9] * (2 if len(v) == 2 else 0), group=2).orderBy("seq").collect()
    assert [r["label"] for r in got] == ["ANOMALY"] * 4 + ["error"]


# ---------------------------------------------------------------- status deltas

@pytest.fixture()
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    jobs.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


STATUS = "src_ip string, seq long, t string, status string"


def status_stream(spark, batches):
    return arriving(spark, batches, STATUS).withColumn("ts", F.col("t").cast("timestamp"))


def test_deltas_follow_the_statuses(spark, rocksdb):
    draw, seq, batches = random.Random(5), 0, []
    for _ in range(4):
        rows = []
        for _ in range(40):
            rows.append((draw.choice([*"abcdefgh", None]), seq, "2024-01-01 00:00:00", draw.choice(["Active", "Blocked", "Monitoring", None])))
            seq += 1
        draw.shuffle(rows)
        batches.append(rows)
    batches.append([("a", -1, "2024-01-01 00:00:00", "Blocked")])  # older than what is known
    path, stream = fresh_path(spark, "deltas"), states.threat_deltas(status_stream(spark, batches))
    sinks.drain(stream, sinks.changelog(path), "update")
    log = sinks.read_changelog(spark, path, stream.schema).collect()
    held, sums = {}, [0, 0, 0]
    for n, rows in enumerate(batches):
        for ip, s, _, status in sorted(rows, key=lambda r: r[1]):
            if ip is not None and s >= held.get(ip, (-1,))[0] and s >= 0:
                held[ip] = (s, status)
        for r in log:
            if r["batch_id"] == n:
                sums = [x + y for x, y in zip(sums, (r["active"], r["blocked"], r["suspicious"]))]
        now = [states.counted(status) for _, status in held.values()]
        assert sums == [sum(c) for c in zip(*now)] and min(sums) >= 0


def test_idle_addresses_leave_the_counters(spark, rocksdb):
    at = lambda minute: f"2024-01-01 00:{minute:02d}:00"
    batches = [[("gone", 1, at(0), "Active"), ("stays", 2, at(0), "Blocked")], [("stays", 3, at(20), "Active")], [("stays", 4, at(40), "Active")], [("stays", 5, at(41), "Active")]]
    stream = states.threat_deltas(status_stream(spark, batches), idle_ms=15 * 60_000, lateness="1 minute")
    log = sinks.drain_to_table(stream).collect()
    gone = [(r["status"], r["active"], r["suspicious"]) for r in sorted(log, key=lambda r: r["active"], reverse=True) if r["src_ip"] == "gone"]
    assert gone == [("Active", 1, 1), (None, -1, -1)]
    assert sum(r["active"] for r in log) == 1


# ---------------------------------------------------------------- gauges

def test_latency_quantiles_stay_within_their_bound(spark):
    draw = random.Random(8)
    values = [int(2 ** draw.uniform(0, 20)) for _ in range(900)]
    rows = [(f"2024-01-01 00:{i % 3:02d}:00.{i:03d}", v) for i, v in enumerate(values)]
    batches = [rows[n::4] for n in range(4)]
    stream = arriving(spark, batches, "t string, ms long").select(F.col("t").cast("timestamp_ntz").alias("ts"), "ms")
    done = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("ms") * 1000).cast("timestamp_ntz")
    cells = sinks.drain_to_table(gauges.latency_cells(stream.withColumn("done", done), "ts", "done"), "update", ["minute", "cell"])
    for r in gauges.latency_quantiles(cells).collect():
        held = sorted(values[r["minute"].minute :: 3])
        assert r["events"] == len(held) == 300
        for name, q in gauges.QUANTILES.items():
            exact = held[-(-len(held) * q // 1000) - 1]
            assert exact * (1 - 1 / 128) <= r[name] <= exact and (exact >= 256 or r[name] == exact)


def test_backlog_rises_and_falls(spark):
    path = fresh_path(spark, "offered")
    put = lambda first, n: spark.range(first, first + n).coalesce(1).write.mode("append").parquet(path)
    put(0, 10)
    out, state = fresh_path(spark, "consumed"), fresh_path(spark, "checkpoint")
    schema = spark.range(1).schema
    gauge = gauges.Backlog(spark, fresh_path(spark, "gauge"), lambda: spark.read.schema(schema).parquet(path))
    run = lambda: sinks.drain(readers.telemetry_source(spark, path, schema, files_per_batch=1), gauge.noted(sinks.changelog(out)), checkpoint=state)
    run()
    assert gauge.now() == 0
    put(10, 5)
    put(15, 7)
    assert gauge.now() == 12  # the consumer stands still
    run()
    assert [tuple(r) for r in gauge.history().orderBy("batch_id").select("offered", "processed", "backlog").collect()] == [(10, 10, 0), (22, 15, 7), (22, 22, 0)]


def test_backlog_reads_notes_and_footers_once(spark, monkeypatch):
    """A batch costs no job for the note before it, nor for files that were counted."""
    path, schema = fresh_path(spark, "offered"), spark.range(1).schema
    spark.range(0, 10, numPartitions=1).write.parquet(path)
    counted = []

    class Offered:
        def __init__(self):
            self.frame = spark.read.schema(schema).parquet(path)

        def inputFiles(self):
            return self.frame.inputFiles()

        def count(self):
            counted.append(1)
            return self.frame.count()

    gauge = gauges.Backlog(spark, fresh_path(spark, "gauge"), Offered)
    note = gauge.noted(lambda df, batch_id: None)
    for n in range(3):
        note(spark.range(n * 2, n * 2 + 2), n)
    note(spark.range(4, 6), 2)  # a replay
    assert len(counted) == 1 and gauge.now() == 4
    again = gauges.Backlog(spark, gauge.path, Offered)  # after a restart
    spark.range(10, 15, numPartitions=1).write.mode("append").parquet(path)
    again.noted(lambda df, batch_id: None)(spark.range(6, 7), 3)
    assert [tuple(r) for r in again.history().orderBy("batch_id").select("offered", "processed", "backlog").collect()] == [
        (10, 2, 8), (10, 4, 6), (10, 6, 4), (15, 7, 8)]


def test_backlog_of_a_change_log_costs_one_job_a_batch(spark):
    """Rows are counted as they are written, and the note is no job; empty and replayed batches are as others."""
    path, schema = fresh_path(spark, "offered"), spark.range(1).schema
    spark.range(0, 10, numPartitions=1).write.parquet(path)
    gauge = gauges.Backlog(spark, fresh_path(spark, "gauge"), lambda: spark.read.schema(schema).parquet(path))
    note = gauge.noted(sinks.changelog(fresh_path(spark, "out")), once=True)
    note(spark.range(0, 3, numPartitions=2), 0)  # counts what is offered
    spark.sparkContext.setJobGroup("one batch", "")
    note(spark.range(3, 7, numPartitions=3), 1)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("one batch")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1
    note(spark.range(3, 7, numPartitions=3), 1)
    note(spark.range(0, numPartitions=1), 2)
    assert [tuple(r) for r in gauge.history().orderBy("batch_id").select("offered", "processed", "backlog").collect()] == [(10, 3, 7), (10, 7, 3), (10, 7, 3)]
