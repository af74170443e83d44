"""Streaming jobs, drained over the given tables and compared with their batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.operators import summary, threats
from vigilframe.operators.models import heuristic_score
from vigilframe.plans.aggregates import ATTACK, PARSED
from vigilframe.plans.registry import query
from vigilframe.plans.storage import BLOCK, log_folder
from vigilframe.plans.windows import SUPPRESS, ema
from vigilframe.session import fresh_path
from vigilframe.sources import following, readers, views, writers
from vigilframe.streaming import gauges, jobs, scoring, sinks, states, tables


def events_stream(spark, sf):
    schema = views.table(spark, sf, "events").schema
    return readers.telemetry_source(spark, sf, schema, "events.parquet")


def telemetry_stream(spark, sf):
    return views.telemetry_from(events_stream(spark, sf))


def attack_stream(spark, sf):
    return summary.with_attack(telemetry_stream(spark, sf))


def parsed_stream(spark, sf):
    from vigilframe.operators import logs
    return logs.parse_lines(views.log_lines_from(events_stream(spark, sf)), views.as_of())


ROWS_PER_BATCH = 20_000
EARLY = "ts < TIMESTAMP '2024-01-11 00:00:00'"
EVENT_FIELDS = ["event_id", "ts", "user_id", "event_type", "value"]


def arriving_events(spark, sf):
    """A folder that events arrive in, and what adds the early or the other ones to it."""
    path, events = fresh_path(spark, "arriving"), views.table(spark, sf, "events")

    def arrive(part):
        # Row groups of some ten thousand records: a batch of records decodes few others.
        events.where(part).write.mode("append").option("parquet.block.size", 1 << 20).parquet(path)

    return path, arrive, events.select(*EVENT_FIELDS).schema


@query("a19_telemetry_source", "", "SELECT event_id, ts, user_id, event_type, value FROM events")
def source(spark, sf):
    """All records in batches of rows; the run stops in between and goes on where it was."""
    folder, arrive, schema = arriving_events(spark, sf)
    out, state, place = (fresh_path(spark, n) for n in ("records", "checkpoint", "place"))
    for part in (EARLY, f"NOT ({EARLY})"):
        arrive(part)
        stream = following.follow_events(spark, folder, schema, rows_per_batch=ROWS_PER_BATCH, progress=place)
        sinks.follow(stream, sinks.changelog(out), checkpoint=state)
    return sinks.read_changelog(spark, out, schema).drop("batch_id")


@query("a19_telemetry_from_now", "", f"SELECT event_id, ts, user_id, event_type, value FROM events WHERE NOT ({EARLY})")
def source_from_now(spark, sf):
    """Started when the early records are there already, it reads only what comes later."""
    folder, arrive, schema = arriving_events(spark, sf)
    out, state, place = (fresh_path(spark, n) for n in ("records", "checkpoint", "place"))
    for part in (EARLY, f"NOT ({EARLY})"):
        arrive(part)
        stream = following.follow_events(spark, folder, schema, start="latest", rows_per_batch=ROWS_PER_BATCH, progress=place)
        sinks.follow(stream, sinks.changelog(out), checkpoint=state)
    return sinks.read_changelog(spark, out, schema).drop("batch_id")


@query("a20_log_tail_source", "log_lines", "SELECT line FROM log_lines")
def tail(spark, sf):
    """Lines of the files there, then, from the checkpoint, those of the files that came since."""
    lines = views.log_lines(spark, sf)
    early = F.col("line") < "[2024-01-01 00:30"
    folder, out, state = (fresh_path(spark, n) for n in ("logs", "tailed", "checkpoint"))
    for part in (early, ~early):
        writers.write_log_lines(lines.filter(part), folder)
        sinks.drain(readers.log_tail_source(spark, folder, "*.txt"), sinks.changelog(out), checkpoint=state)
    return spark.read.parquet(out).select("line")


@query("i1_stream_ingest", "inbound", """
SELECT seq, seq % 83 <> 0 AND seq % 89 <> 0 AND seq % 97 <> 0 AND seq % 79 <> 0 AND seq % 73 <> 0 AND seq % 107 <> 0 AS accepted FROM inbound
WHERE NOT regexp_matches(lower(trim(coalesce(message, ''))), '^sensor auto-pulse')""")
def stream_ingest(spark, sf):
    inbound = views._over(spark, views.view_sql("inbound", "spark"), telemetry=telemetry_stream(spark, sf))
    good, bad = fresh_path(spark, "accepted"), fresh_path(spark, "rejected")
    sinks.drain(inbound, jobs.ingest_writer(good, bad, producer="Sensor"))
    seq = lambda path, ok: spark.read.parquet(path).select("seq", F.lit(ok).alias("accepted"))
    return seq(good, True).unionByName(seq(bad, False))


@query("i2_stream_packet_totals", "log_lines", f"""WITH {PARSED}
SELECT count(*) AS total_packets, count(*) FILTER (category = 'attack') AS attack_packets, count(*) FILTER (category <> 'attack') AS normal_packets,
 count(DISTINCT CASE WHEN category = 'attack' THEN src_ip END) AS unique_ips_blocked FROM parsed""")
def stream_totals(spark, sf):
    return jobs.totals_of_sources(sinks.drain_to_table(jobs.packets_by_source(parsed_stream(spark, sf)), "update", ["src_ip"]))


@query("i2_stream_blocked_ips", "log_lines", f"""WITH {PARSED}
SELECT src_ip, count(*) AS count FROM parsed WHERE category = 'attack' AND src_ip IS NOT NULL GROUP BY 1""")
def stream_blocked(spark, sf):
    latest = sinks.drain_to_table(jobs.packets_by_source(parsed_stream(spark, sf)), "update", ["src_ip"])
    return latest.filter("src_ip <> '' and attacks > 0").select("src_ip", F.col("attacks").alias("count"))


@query("i3_stream_minute_buckets", "telemetry", f"""
SELECT date_trunc('minute', ts) AS minute, count(*) FILTER ({ATTACK}) AS attack, count(*) FILTER (NOT {ATTACK}) AS normal FROM telemetry GROUP BY 1""")
def stream_minutes(spark, sf):
    return minute_totals(spark, sf)


def minute_totals(spark, sf):
    minutes = tables.MinuteTotals(spark, fresh_path(spark, "minutes"))
    sinks.drain(attack_stream(spark, sf), minutes.write)
    return minutes.totals()


@query("i4_stream_attack_summary", "telemetry", f"""
WITH w AS (SELECT unnest(generate_series(date_trunc('minute', ts) + INTERVAL 1 MINUTE, date_trunc('minute', ts) + INTERVAL 5 MINUTE, INTERVAL 1 MINUTE)) AS window_end, {ATTACK} AS attack FROM telemetry)
SELECT window_end, count(*) AS total_events, round(count(*) FILTER (attack) / CAST(5 AS DOUBLE), 2) AS attack_rate FROM w GROUP BY 1""")
def stream_summary(spark, sf):
    return tables.trailing_summary(minute_totals(spark, sf), minutes=5)


@query("i5_stream_threat_index", "telemetry", f"""WITH {ema('PARTITION BY src_ip')}
SELECT src_ip, round(arg_max(s, seq), 6) AS threat_index, count(*) AS events FROM ema GROUP BY 1""")
def stream_index(spark, sf):
    out = sinks.drain_to_table(jobs.threat_index_stream(telemetry_stream(spark, sf)), "update", ["src_ip"])
    return out.withColumn("threat_index", F.round("threat_index", 6))


@query("i6_stream_threat_state", "telemetry", """
WITH l AS (SELECT src_ip, arg_max(status, seq) AS status FROM telemetry GROUP BY 1)
SELECT count(*) FILTER (status = 'Active') AS active_threats, count(*) FILTER (status = 'Blocked') AS blocked_ips,
 count(*) FILTER (status <> 'Blocked') AS suspicious_ips, (SELECT round(avg(confidence), 2) FROM telemetry) AS avg_confidence FROM l""")
def stream_state(spark, sf):
    latest = sinks.drain_to_table(jobs.threat_state_stream(telemetry_stream(spark, sf)), "update", ["src_ip"])
    return threats.stats_of_latest(latest)


@query("c4_stream_previous_status", "telemetry", """
SELECT seq, src_ip, lag(status) OVER (PARTITION BY src_ip ORDER BY seq) AS previous FROM telemetry""")
def stream_previous(spark, sf):
    path = fresh_path(spark, "moves")
    latest = tables.KeyedTable(spark, fresh_path(spark, "latest"), jobs.STATUSES, ["src_ip"])
    sinks.drain(telemetry_stream(spark, sf), jobs.transitions_writer(path, latest))
    return spark.read.parquet(path).select("seq", "src_ip", "previous")


@query("i7_stream_score", "telemetry", """
WITH s AS (SELECT seq, tanh((confidence + vector / 360) / (2 + 1e-6)) AS score FROM telemetry)
SELECT seq, round(score, 9) AS score, CASE WHEN score >= 0.5 THEN 'ANOMALY' ELSE 'NORMAL' END AS label FROM s""")
def stream_score(spark, sf):
    rows = telemetry_stream(spark, sf).select("seq", "confidence", (F.col("vector") / 360).alias("vector"))
    scores = sinks.drain_to_table(scoring.scored_in_groups(rows, ["confidence", "vector"]), label="scores")
    return scores.select("seq", F.round("score", 9).alias("score"), "label")


@query("i8_stream_detect_and_route", "telemetry", BLOCK.format(cond="is_attack"))
def stream_route(spark, sf):
    root = fresh_path(spark, "routed")
    scorer = lambda df: df.withColumn("score", F.col("is_attack").cast("double"))
    sinks.drain(telemetry_stream(spark, sf), jobs.route_writer(scorer, root))
    return jobs.read_blocklist(spark, root)


@query("i9_resume_after_crash", "telemetry", "SELECT seq, src_ip FROM telemetry")
def resume(spark, sf):
    """The first run dies after writing a batch and before committing it; the second resumes."""
    path, checkpoint = fresh_path(spark, "resumed"), fresh_path(spark, "checkpoint")
    write = sinks.changelog(path)

    def crash(df, batch_id):
        write(df, batch_id)
        raise RuntimeError("lost before commit")

    stream = telemetry_stream(spark, sf).select("seq", "src_ip")
    try:
        sinks.drain(stream, crash, checkpoint=checkpoint)
    except Exception as exc:
        if "lost before commit" not in str(exc):
            raise
    sinks.drain(stream, write, checkpoint=checkpoint)
    return spark.read.parquet(path).select("seq", "src_ip")


@query("i10_stream_retention", "telemetry", "SELECT seq, src_ip FROM telemetry ORDER BY seq DESC LIMIT 500")
def retention(spark, sf):
    path = fresh_path(spark, "retained")
    sinks.drain(telemetry_stream(spark, sf).select("seq", "src_ip"), jobs.retention_writer(path, 500))
    return jobs.newest_version(spark, path)


@query("i11_stream_live_feed", "telemetry", """
SELECT seq, src_ip FROM telemetry WHERE ts >= TIMESTAMP '2024-01-01 00:30:00' UNION ALL
(SELECT seq, src_ip FROM telemetry WHERE ts < TIMESTAMP '2024-01-01 00:30:00' ORDER BY seq DESC LIMIT 50)""")
def live_feed(spark, sf):
    start = F.lit("2024-01-01 00:30:00").cast("timestamp_ntz")
    history = views.telemetry(spark, sf).filter(F.col("ts") < start).select("seq", "src_ip")
    return jobs.live_feed(history, telemetry_stream(spark, sf).filter(F.col("ts") >= start).select("seq", "src_ip"))


@query("i12_stream_dedup", "telemetry", "SELECT concat('e', CAST(seq // 3 AS VARCHAR)) AS id, min(seq) AS seq FROM telemetry GROUP BY 1")
def stream_dedup(spark, sf):
    rows = telemetry_stream(spark, sf).select(F.concat(F.lit("e"), F.floor(F.col("seq") / 3).cast("string")).alias("id"), "seq")
    path = fresh_path(spark, "firsts")
    sinks.drain(rows, tables.first_of_id_writer(tables.SeenIds(spark, fresh_path(spark, "seen")), path, "seq"))
    return sinks.read_changelog(spark, path, rows.schema).drop("batch_id")


@query("i13_stream_log_analytics", "log_lines", f"""WITH {PARSED}
SELECT parsed.ts AS timestamp, line, category AS type FROM parsed JOIN log_lines USING (seq)""")
def stream_logs(spark, sf):
    lines = readers.log_tail_source(spark, log_folder(spark, sf), "*.txt")
    return sinks.drain_to_table(jobs.log_messages(lines, views.as_of()))


@query("i14_stream_backlog", "", f"""
WITH n AS (SELECT count(*) FILTER ({EARLY}) AS early, count(*) AS total FROM events),
r AS (SELECT 0 AS start, early AS stop FROM n UNION ALL SELECT early, total FROM n),
b AS (SELECT stop AS offered, least(stop, start + {ROWS_PER_BATCH} * k) AS processed FROM r, generate_series(1, 1000) AS g(k) WHERE start + {ROWS_PER_BATCH} * (k - 1) < stop)
SELECT CAST(offered AS BIGINT) AS offered, CAST(processed AS BIGINT) AS processed, CAST(offered - processed AS BIGINT) AS backlog FROM b""")
def stream_backlog(spark, sf):
    """The gauge of a consumer that is behind twice: it rises as records arrive and falls as they are read."""
    folder, arrive, schema = arriving_events(spark, sf)
    out, state, place = (fresh_path(spark, n) for n in ("records", "checkpoint", "place"))
    gauge = gauges.Backlog(spark, fresh_path(spark, "backlog"), lambda: spark.read.schema(schema).parquet(folder))
    for part in (EARLY, f"NOT ({EARLY})"):
        arrive(part)
        stream = following.follow_events(spark, folder, schema, rows_per_batch=ROWS_PER_BATCH, progress=place)
        sinks.follow(stream, gauge.noted(sinks.changelog(out), once=True), checkpoint=state)
    return gauge.history().drop("batch_id")


@query("e10_stream_suppress_alerts", "telemetry", f"""WITH RECURSIVE {SUPPRESS.strip()}
SELECT seq, src_ip, level, identity, ms FROM walk WHERE ok""")
def stream_suppress(spark, sf):
    return sinks.drain_to_table(jobs.suppressed_stream(threats.alert_messages(telemetry_stream(spark, sf))))


@query("d33_detection_latency", "telemetry", """
WITH p AS (SELECT date_trunc('minute', ts) AS minute, CAST((epoch_us(ts + to_milliseconds((seq * 13) % 200)) // 1000) - (epoch_us(ts) // 1000) AS DOUBLE) AS ms FROM telemetry)
SELECT minute, count(*) AS events, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95, round(quantile_cont(ms, 0.99), 6) AS p99 FROM p GROUP BY 1""")
def latency(spark, sf):
    done = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (F.col("seq") * 13) % 200 * 1000).cast("timestamp_ntz")
    scored = sinks.drain_to_table(telemetry_stream(spark, sf).select("seq", "ts", done.alias("processed")))
    out = jobs.detection_latency(scored, "ts", "processed")
    return out.select("minute", "events", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


LATENCY = 13 * 37  # spreads the made latencies over more than one cell size


@query("d33_stream_latency_sketch", "telemetry", f"""
WITH p AS (SELECT date_trunc('minute', ts) AS minute, (seq * {LATENCY}) % 2000 AS ms FROM telemetry),
c AS (SELECT minute, (ms >> greatest(length(bin(ms)) - 8, 0)) << greatest(length(bin(ms)) - 8, 0) AS cell FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY minute ORDER BY cell) AS k, count(*) OVER (PARTITION BY minute) AS events FROM c)
SELECT minute, any_value(events) AS events, min(cell) FILTER (k * 1000 >= events * 500) AS p50, min(cell) FILTER (k * 1000 >= events * 950) AS p95,
 min(cell) FILTER (k * 1000 >= events * 990) AS p99 FROM n GROUP BY 1""")
def latency_sketch(spark, sf):
    done = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (F.col("seq") * LATENCY) % 2000 * 1000).cast("timestamp_ntz")
    stream = telemetry_stream(spark, sf).select("ts", done.alias("processed"))
    cells = sinks.drain_to_table(gauges.latency_cells(stream, "ts", "processed"), "update", ["minute", "cell"], label="cells")
    return gauges.latency_quantiles(cells)


@query("c4_stream_counter_deltas", "telemetry", """
WITH l AS (SELECT src_ip, arg_max(status, seq) AS status FROM telemetry GROUP BY 1)
SELECT count(*) FILTER (status = 'Active') AS active, count(*) FILTER (status = 'Blocked') AS blocked, count(*) FILTER (status <> 'Blocked') AS suspicious FROM l""")
def stream_deltas(spark, sf):
    jobs.use_rocksdb(spark)
    return states.counters(sinks.drain_to_table(states.threat_deltas(telemetry_stream(spark, sf)), "update", label="deltas"))
