"""Order-dependent queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.operators import health, summary, threats
from vigilframe.operators import importance as imp
from vigilframe.plans.lookups import NORM, norm_importance
from vigilframe.plans.registry import query
from vigilframe.plans.scalar import ASOF
from vigilframe.sources import views

W = "CASE severity WHEN 'ALERT' THEN 50.0::DOUBLE WHEN 'WARNING' THEN 30.0::DOUBLE ELSE 10.0::DOUBLE END"


def ema(partition: str) -> str:
    return f"""ema AS (SELECT seq, ts, src_ip, list_sum([x * pow(0.5::DOUBLE, len(l) - i) FOR x, i IN l]) AS s FROM
 (SELECT seq, ts, src_ip, list({W}) OVER ({partition} ORDER BY seq ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) AS l FROM telemetry))"""


@query("e1_threat_index_per_source", "telemetry", f"WITH {ema('PARTITION BY src_ip')} SELECT seq, src_ip, round(s, 6) AS threat_index FROM ema")
def ema_source(spark, sf):
    return threats.threat_index_per_source(views.telemetry(spark, sf)).select("seq", "src_ip", F.round("threat_index", 6).alias("threat_index"))


@query("e1_threat_index_trajectory", "telemetry", f"WITH {ema('')} SELECT seq, round(s, 6) AS threat_index FROM ema")
def ema_global(spark, sf):
    return threats.threat_index_trajectory(views.telemetry(spark, sf)).select("seq", F.round("threat_index", 6).alias("threat_index"))


@query("e1_threat_index_final", "telemetry", f"""WITH {ema('PARTITION BY src_ip')}
SELECT src_ip, round(arg_max(s, seq), 6) AS threat_index FROM ema GROUP BY 1""")
def ema_final(spark, sf):
    return threats.threat_index_final(views.telemetry(spark, sf), per_source=True).select("src_ip", F.round("threat_index", 6).alias("threat_index"))


@query("e2_threat_index_snapshot", "telemetry", f"""WITH {ema('')}, f AS (SELECT arg_max(s, seq) AS s, count(*) AS count FROM ema)
SELECT round(s, 2) AS threat_index, CASE WHEN s >= 80 THEN 'critical' WHEN s >= 60 THEN 'high' WHEN s >= 30 THEN 'elevated' WHEN s >= 10 THEN 'low' ELSE 'normal' END AS status, count FROM f""")
def snapshot(spark, sf):
    return threats.threat_index_snapshot(views.telemetry(spark, sf))


@query("e3_status_transition", "telemetry", """
WITH l AS (SELECT seq, src_ip, lag(status) OVER (PARTITION BY src_ip ORDER BY seq) AS previous, status FROM telemetry)
SELECT previous, status, count(*) AS transitions, min(seq) AS first_seq FROM l GROUP BY 1, 2""")
def transitions(spark, sf):
    t = threats.status_transition(views.telemetry(spark, sf))
    return t.groupBy("previous", "status").agg(F.count("*").alias("transitions"), F.min("seq").alias("first_seq"))


@query("e4_ip_activity_history", "telemetry", """
SELECT seq, src_ip, array_to_string(list(CAST(floor(confidence * 100 + 0.5) AS INT)) OVER (PARTITION BY src_ip ORDER BY seq ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), ',') AS activity FROM telemetry""")
def history(spark, sf):
    h = threats.activity_history(views.telemetry(spark, sf))
    return h.select("seq", "src_ip", F.array_join(F.col("activity").cast("array<string>"), ",").alias("activity"))


@query("e5_cumulative_event_counter", "telemetry", f"""
WITH n AS (SELECT seq, ts, row_number() OVER (ORDER BY seq) AS value FROM telemetry ORDER BY seq DESC LIMIT 100)
SELECT * FROM n WHERE ts >= {ASOF} - INTERVAL 5 MINUTE""")
def counter(spark, sf):
    return threats.cumulative_counter(views.telemetry(spark, sf), views.AS_OF)


@query("e6_importance_rank", "telemetry importance", f"""WITH {NORM}
SELECT name, CAST(row_number() OVER (ORDER BY normalized_score DESC, name) AS INT) AS display_rank,
 floor(round(normalized_score * 1000, 6) + 0.5) / 10 AS normalized_percent FROM norm""")
def rank(spark, sf):
    return imp.importance_rank(norm_importance(spark, sf))


def _buckets(rows):
    return f"""s AS (SELECT unnest(generate_series({ASOF} - INTERVAL 59 MINUTE, {ASOF}, INTERVAL 1 MINUTE)) AS minute),
c AS (SELECT date_trunc('minute', ts) AS minute, count(*) AS count FROM telemetry WHERE {rows} AND ts >= {ASOF} - INTERVAL 60 MINUTE GROUP BY 1),
b AS (SELECT minute, coalesce(count, 0) AS count FROM s LEFT JOIN c USING (minute))"""


def buckets(spark, sf, rows):
    return summary.timeline(views.telemetry(spark, sf).where(rows), views.AS_OF, 60)


ALERTS = "severity = 'ALERT'"


@query("e7_spike_or_cooldown", "telemetry", f"""WITH {_buckets(ALERTS)},
m AS (SELECT *, avg(count) OVER w AS mean, count(*) OVER w AS n FROM b WINDOW w AS (ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT minute, count, CASE WHEN n < 1 THEN 'steady' WHEN count > mean * 1.5 AND count >= 3 THEN 'spike' WHEN count <= mean * 0.5 AND mean > 0 THEN 'cooled' ELSE 'steady' END AS state FROM m""")
def spike(spark, sf):
    return summary.spike_states(buckets(spark, sf, ALERTS))


@query("e8_recent_spike", "telemetry", f"""WITH {_buckets("true")}, n AS (SELECT * FROM b ORDER BY minute DESC LIMIT 3)
SELECT minute, count FROM n WHERE count >= 5 ORDER BY minute LIMIT 1""")
def recent_spike(spark, sf):
    return summary.recent_spike(buckets(spark, sf, "true"))


JUMPS = f"""{ema('PARTITION BY src_ip')},
lagged AS (SELECT *, round(s - coalesce(lag(s) OVER (PARTITION BY src_ip ORDER BY seq), 0), 6) AS change FROM ema),
jumps AS (SELECT seq, ts, src_ip, change, CASE WHEN change >= 15 THEN 'up' WHEN change <= -20 THEN 'down' END AS jump FROM lagged WHERE change >= 15 OR change <= -20)"""


@query("e9_level_jump", "telemetry", f"WITH {JUMPS} SELECT seq, src_ip, jump, change FROM jumps")
def jumps(spark, sf):
    return threats.level_jumps(views.telemetry(spark, sf)).drop("ms")


@query("e9_level_jump_cooldown", "telemetry", f"""WITH RECURSIVE {JUMPS},
o AS (SELECT seq, src_ip, jump, (epoch_us(ts) // 1000) AS ms, row_number() OVER (PARTITION BY src_ip ORDER BY seq) AS n FROM jumps),
walk AS (SELECT seq, src_ip, jump, n, ms AS last, true AS ok FROM o WHERE n = 1
 UNION ALL SELECT o.seq, o.src_ip, o.jump, o.n,
  CASE WHEN o.ms - w.last > CASE o.jump WHEN 'up' THEN 2500 ELSE 4000 END THEN o.ms ELSE w.last END,
  o.ms - w.last > CASE o.jump WHEN 'up' THEN 2500 ELSE 4000 END
 FROM walk w JOIN o ON o.src_ip = w.src_ip AND o.n = w.n + 1)
SELECT seq, src_ip, jump FROM walk WHERE ok""")
def jump_signals(spark, sf):
    return threats.level_signals(views.telemetry(spark, sf))


SUPPRESS = """
m AS (SELECT seq, src_ip, CASE WHEN severity IN ('ALERT','CRITICAL') THEN 'critical' WHEN severity IN ('WARNING','HIGH') THEN 'warning' ELSE 'info' END AS level,
 lower(label) AS identity, (epoch_us(ts) // 1000) AS ms, row_number() OVER (PARTITION BY src_ip ORDER BY seq) AS n FROM telemetry),
walk AS (
 SELECT seq, src_ip, level, identity, ms, n, true AS ok, map([identity], [ms]) AS texts, map([level], [ms]) AS levels FROM m WHERE n = 1
 UNION ALL
 SELECT seq, src_ip, level, identity, ms, n, ok, CASE WHEN ok THEN map_concat(texts, map([identity], [ms])) ELSE texts END,
  CASE WHEN ok THEN map_concat(levels, map([level], [ms])) ELSE levels END
 FROM (SELECT m.*, w.texts, w.levels, coalesce(m.ms - w.texts[m.identity] >= 60000, true)
   AND coalesce(m.ms - w.levels[m.level] >= CASE m.level WHEN 'info' THEN 5000 WHEN 'warning' THEN 3000 ELSE 1000 END, true) AS ok
  FROM walk w JOIN m ON m.src_ip = w.src_ip AND m.n = w.n + 1))"""


@query("e10_suppress_alerts", "telemetry", f"""WITH RECURSIVE {SUPPRESS.strip()}
SELECT seq, src_ip, level, identity, ms, CASE level WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS priority FROM walk WHERE ok""")
def suppress(spark, sf):
    return threats.suppress_alerts(threats.alert_messages(views.telemetry(spark, sf)))


@query("e11_retain_recent", "telemetry", f"""
WITH r AS (SELECT * FROM telemetry WHERE ts >= {ASOF} - INTERVAL 8 SECOND ORDER BY seq DESC LIMIT 100),
h AS (SELECT seq, src_ip, dst_ip, list_sum([CAST(x AS BIGINT) * CAST(pow(256, 4 - i) AS BIGINT) FOR x, i IN string_split(src_ip, '.')]) AS a,
 list_sum([CAST(x AS BIGINT) * CAST(pow(256, 4 - i) AS BIGINT) FOR x, i IN string_split(dst_ip, '.')]) AS b0 FROM r),
g AS (SELECT *, CASE WHEN b0 >= 2147483648 THEN b0 - 4294967296 ELSE b0 END AS b FROM h)
SELECT seq, src_ip, dst_ip, CAST(greatest(-85, least(85, a % 180 - 90)) AS INT) AS src_lat, CAST((CAST(a AS BIGINT) >> 8) % 360 - 180 AS INT) AS src_lon,
 CAST(greatest(-85, least(85, (b % 180 + 180) % 180 - 90)) AS INT) AS dst_lat, CAST((CAST(floor(b / 256.0) AS BIGINT) % 360 + 360) % 360 - 180 AS INT) AS dst_lon FROM g""")
def arcs(spark, sf):
    return threats.retain_arcs(views.telemetry(spark, sf), views.AS_OF)


@query("e12_metric_history", "host_metrics", """
SELECT seq, host, ts, cpu, memory, latency_ms FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY seq DESC) AS r FROM host_metrics) WHERE r <= 60""")
def metric_history(spark, sf):
    return health.metric_history(views.host_metrics(spark, sf))


@query("e13_recent_activity", "telemetry", f"""
WITH s AS (SELECT unnest(generate_series({ASOF} - INTERVAL 5 MINUTE, {ASOF}, INTERVAL 1 MINUTE)) AS minute),
c AS (SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM telemetry WHERE ts >= {ASOF} - INTERVAL 10 MINUTE GROUP BY 1)
SELECT string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY minute) AS activity FROM s LEFT JOIN c USING (minute)""")
def activity(spark, sf):
    line = summary.timeline(views.telemetry(spark, sf), views.AS_OF, 10)
    return summary.recent_activity(line).select(F.array_join(F.col("activity").cast("array<string>"), ",").alias("activity"))

