"""Grouped and scalar aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.operators import distribution, evaluation, flows, health, logs, summary, threats
from vigilframe.operators import importance as imp
from vigilframe.plans.lookups import NORM, TOPIP, WIN, attack_telemetry, norm_importance
from vigilframe.plans.registry import query
from vigilframe.plans.scalar import ASOF
from vigilframe.sources import views

ATTACK = "(is_attack OR contains(lower(label), 'attack') OR contains(lower(label), 'malicious') OR severity IN ('ALERT','CRITICAL','HIGH'))"
PARSED = f"""parsed AS (SELECT seq, CASE WHEN contains(line, '[ATTACK DETECTED]') THEN 'attack' ELSE 'normal' END AS category,
 CASE WHEN contains(line, 'Src IP') THEN regexp_extract(line, 'Src IP: ([^ ]+)', 1) END AS src_ip,
 coalesce(try_strptime(nullif(regexp_extract(line, '^\\[([^\\]]*)\\]', 1), ''), '%Y-%m-%d %H:%M:%S'), {ASOF}) AS ts FROM log_lines)"""


def parsed(spark, sf):
    return logs.parse_lines(views.log_lines(spark, sf), views.as_of())


@query("d1_packet_totals", "log_lines", f"""WITH {PARSED}
SELECT count(*) AS total_packets, count(*) FILTER (category = 'attack') AS attack_packets, count(*) FILTER (category <> 'attack') AS normal_packets,
 count(DISTINCT CASE WHEN category = 'attack' THEN src_ip END) AS unique_ips_blocked FROM parsed""")
def totals(spark, sf):
    return logs.packet_totals(parsed(spark, sf))


@query("d2_minute_breakdown", "log_lines", f"""WITH {PARSED}
SELECT date_trunc('minute', ts) AS minute, count(*) FILTER (category = 'attack') AS attack, count(*) FILTER (category = 'normal') AS normal FROM parsed GROUP BY 1""")
def breakdown(spark, sf):
    return logs.minute_breakdown(parsed(spark, sf))


@query("d3_blocked_ip_counts", "log_lines", f"""WITH {PARSED}
SELECT src_ip, count(*) AS count FROM parsed WHERE category = 'attack' AND src_ip IS NOT NULL GROUP BY 1""")
def blocked(spark, sf):
    return logs.blocked_ip_counts(parsed(spark, sf))


@query("d4_attack_summary_totals", "telemetry", f"""WITH {WIN}
SELECT count(*) AS total_events, round(count(*) FILTER (attack) / CAST(5 AS DOUBLE), 2) AS attack_rate FROM win""")
def d4_totals(spark, sf):
    return summary.totals(attack_telemetry(spark, sf), views.AS_OF, 5)


@query("d4_attack_summary_top_ips", "telemetry", f"WITH {WIN}, {TOPIP} SELECT src_ip, count FROM top")
def d4_ips(spark, sf):
    return summary.top_k(threats.lookback(views.telemetry(spark, sf), views.AS_OF, 5), "src_ip")


@query("d4_attack_summary_top_ports", "telemetry", f"""WITH {WIN}
SELECT CAST(dst_port AS VARCHAR) AS dst_port, count(*) AS count FROM win GROUP BY 1 ORDER BY 2 DESC, max(seq) DESC LIMIT 10""")
def d4_ports(spark, sf):
    w = threats.lookback(views.telemetry(spark, sf), views.AS_OF, 5)
    return summary.top_k(w.withColumn("dst_port", F.col("dst_port").cast("string")), "dst_port")


@query("d4_attack_summary_timeline", "telemetry", f"""
WITH spine AS (SELECT unnest(generate_series({ASOF} - INTERVAL 4 MINUTE, {ASOF}, INTERVAL 1 MINUTE)) AS minute),
c AS (SELECT date_trunc('minute', ts) AS minute, count(*) AS count FROM telemetry WHERE ts >= {ASOF} - INTERVAL 5 MINUTE GROUP BY 1)
SELECT strftime(minute, '%H:%M') AS minute, coalesce(count, 0) AS count FROM spine LEFT JOIN c USING (minute)""")
def d4_timeline(spark, sf):
    line = summary.timeline(views.telemetry(spark, sf), views.AS_OF, 5)
    return line.select(F.date_format("minute", "HH:mm").alias("minute"), "count")


@query("d4_attack_summary_document", "telemetry", f"""WITH {WIN}, {TOPIP},
p AS (SELECT CAST(dst_port AS VARCHAR) AS v, count(*) AS c, max(seq) AS l FROM win GROUP BY 1 ORDER BY 2 DESC, 3 DESC LIMIT 10),
q AS (SELECT proto AS v, count(*) AS c, max(seq) AS l FROM win GROUP BY 1),
spine AS (SELECT unnest(generate_series({ASOF} - INTERVAL 4 MINUTE, {ASOF}, INTERVAL 1 MINUTE)) AS minute),
m AS (SELECT date_trunc('minute', ts) AS minute, count(*) AS count FROM win GROUP BY 1),
t AS (SELECT minute, coalesce(count, 0) AS count FROM spine LEFT JOIN m USING (minute))
SELECT (SELECT count(*) FROM win) AS total_events, (SELECT round(count(*) FILTER (attack) / CAST(5 AS DOUBLE), 2) FROM win) AS attack_rate,
 (SELECT string_agg(concat(src_ip, '=', CAST(count AS VARCHAR)), ' ' ORDER BY count DESC, last DESC) FROM top) AS top_ips,
 (SELECT string_agg(concat(v, '=', CAST(c AS VARCHAR)), ' ' ORDER BY c DESC, l DESC) FROM p) AS top_ports,
 (SELECT string_agg(concat(v, '=', CAST(c AS VARCHAR)), ' ' ORDER BY c DESC, l DESC) FROM q) AS protocols,
 (SELECT string_agg(concat(strftime(minute, '%H:%M'), '=', CAST(count AS VARCHAR)), ' ' ORDER BY minute) FROM t) AS timeline""")
def d4_document(spark, sf):
    doc = summary.attack_summary(attack_telemetry(spark, sf), views.AS_OF, 5)
    pairs = lambda c, v: F.array_join(F.transform(c, lambda x: F.concat(x[v], F.lit("="), x["count"].cast("string"))), " ").alias(c)
    return doc.select("total_events", "attack_rate", *[pairs(c, "value") for c in ("top_ips", "top_ports", "protocols")], pairs("timeline", "minute"))


@query("d5_protocol_mix", "telemetry", "SELECT proto, count(*) AS count FROM telemetry GROUP BY 1")
def mix(spark, sf):
    return summary.protocol_mix(views.telemetry(spark, sf))


@query("d6_threat_stats", "telemetry", """
WITH l AS (SELECT src_ip, arg_max(status, seq) AS status FROM telemetry GROUP BY 1)
SELECT count(*) FILTER (status = 'Active') AS active_threats, count(*) FILTER (status = 'Blocked') AS blocked_ips,
 count(*) FILTER (status <> 'Blocked') AS suspicious_ips, (SELECT round(avg(confidence), 2) FROM telemetry) AS avg_confidence FROM l""")
def stats(spark, sf):
    return threats.threat_stats(views.telemetry(spark, sf))


@query("d7_attack_frequency_alerts", "telemetry", f"""
WITH a AS (SELECT strftime(ts, '%H:%M') AS minute, count(*) AS count FROM telemetry WHERE severity = 'ALERT' AND ts >= {ASOF} - INTERVAL 10 MINUTE GROUP BY 1)
SELECT minute, count, CAST(sum(count) OVER () AS BIGINT) AS total_events, sum(count) OVER () / CAST(10 AS DOUBLE) AS attack_rate FROM a""")
def frequency(spark, sf):
    return summary.attack_frequency_alerts(threats.alerts_only(views.telemetry(spark, sf)), views.AS_OF, 10)


@query("d8_attack_frequency_window", "telemetry", f"""
WITH p AS (SELECT date_trunc('minute', ts) AS minute, count(*) AS count FROM telemetry WHERE severity = 'ALERT' GROUP BY 1)
SELECT w AS "window", count(minute) AS points, CAST(coalesce(sum(count), 0) AS BIGINT) AS total_events,
 CASE WHEN count(minute) > 0 THEN CAST(sum(count) AS DOUBLE) / greatest(count(minute), max(m)) ELSE 0 END AS average_per_minute
FROM (VALUES ('1M', 1), ('5M', 5), ('1H', 60)) v(w, m) LEFT JOIN p ON p.minute >= {ASOF} - to_minutes(m) GROUP BY 1""")
def frequency_window(spark, sf):
    points = summary.per_minute(threats.alerts_only(views.telemetry(spark, sf)))
    a, b, c = (summary.attack_frequency_window(points, views.AS_OF, w) for w in summary.CHART_WINDOWS)
    return a.unionByName(b).unionByName(c)


@query("d9_anomaly_timeline", "telemetry", """
SELECT strftime(ts, '%Y-%m-%dT%H:%M:00.000Z') AS timestamp, count(*) AS value FROM telemetry WHERE severity = 'ALERT' GROUP BY 1""")
def anomalies(spark, sf):
    per = summary.per_minute(threats.alerts_only(views.telemetry(spark, sf)))
    return per.select(F.date_format("minute", "yyyy-MM-dd'T'HH:mm:00.000'Z'").alias("timestamp"), F.col("count").alias("value")).orderBy("timestamp")


@query("d10_summary_kpis", "telemetry", f"""WITH {WIN}, r AS (SELECT round(count(*) FILTER (attack) / CAST(5 AS DOUBLE), 2) AS rate FROM win)
SELECT (SELECT count(*) FROM win) AS active_threats, (SELECT count(*) FROM win GROUP BY dst_port ORDER BY 1 DESC LIMIT 1) AS blocked_attacks,
 CAST(least(10, (SELECT count(DISTINCT src_ip) FROM win)) AS INT) AS suspicious_ips, greatest(5::DOUBLE, least(99::DOUBLE, rate * 10)) AS avg_confidence FROM r""")
def kpis(spark, sf):
    return summary.summary_kpis(attack_telemetry(spark, sf), views.AS_OF, 5)


@query("d11_live_alert_kpis", "telemetry", """
SELECT count(*) AS active_threats, CAST(round(count(*) * 0.65) AS BIGINT) AS blocked_attacks, count(DISTINCT src_ip) AS suspicious_ips FROM telemetry WHERE severity = 'ALERT'""")
def live(spark, sf):
    return summary.live_alert_kpis(threats.alerts_only(views.telemetry(spark, sf)))


@query("d12_attack_rate_pct", "telemetry", f"""
SELECT round(count(*) FILTER ({ATTACK}) / CAST(count(*) AS DOUBLE) * 100, 6) AS attack_pct FROM telemetry""")
def rate_pct(spark, sf):
    t = attack_telemetry(spark, sf)
    return t.agg(F.round(F.coalesce(F.avg(F.col("attack").cast("double")), F.lit(0.0)) * 100, 6).alias("attack_pct"))


@query("d13_attacks_by_source_ip", "telemetry", f"SELECT src_ip, count(*) AS count FROM telemetry WHERE {ATTACK} GROUP BY 1")
def by_source(spark, sf):
    return attack_telemetry(spark, sf).filter("attack").groupBy("src_ip").agg(F.count("*").alias("count"))


@query("d14_cache_hit_rate", "host_metrics", """
SELECT CAST(sum(hits) AS DOUBLE) / greatest(sum(hits) + sum(misses), 1) AS hit_rate,
 round(CAST(sum(hits) AS DOUBLE) / (sum(hits) + sum(misses)) * 100, 2) AS hit_percent FROM host_metrics""")
def hit_rate(spark, sf):
    return health.cache_hit_rate(views.host_metrics(spark, sf))


@query("d15_column_means", "flows", """
SELECT round(avg(flow_duration), 6) AS flow_duration, round(avg(pkt_len_mean), 4) AS pkt_len_mean, round(avg(bwd_iat), 6) AS bwd_iat,
 round(avg(CASE WHEN NOT isnan(flow_bytes_s) AND NOT isinf(flow_bytes_s) THEN flow_bytes_s END), 4) AS flow_bytes_s FROM flows""")
def means(spark, sf):
    cols = ["flow_duration", "pkt_len_mean", "bwd_iat", "flow_bytes_s"]
    digits = {"pkt_len_mean": 4, "flow_bytes_s": 4}
    return flows.column_means(views.flows(spark, sf), cols).select(*[F.round(c, digits.get(c, 6)).alias(c) for c in cols])


DIST = """f AS (SELECT pkt_len_mean AS x FROM flows),
b AS (SELECT quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi, count(*) AS n FROM f),
c AS (SELECT greatest(lo, least(hi, x)) AS v, lo, hi, CAST(least(30, greatest(10, floor(sqrt(n)))) AS INT) AS bins FROM f, b)"""


@query("d16_feature_distribution_histogram", "flows", f"""WITH {DIST},
h AS (SELECT CAST(least(bins - 1, floor((v - lo) / (hi - lo) * bins)) AS INT) AS bin, count(*) AS count FROM c GROUP BY 1),
s AS (SELECT unnest(range(0, (SELECT max(bins) FROM c))) AS bin)
SELECT CAST(s.bin AS INT) AS bin, round(lo + s.bin * ((hi - lo) / bins), 6) AS edge, coalesce(count, 0) AS count
FROM s LEFT JOIN h ON h.bin = s.bin, (SELECT DISTINCT lo, hi, bins FROM c)""")
def histogram(spark, sf):
    return distribution.histogram(views.flows(spark, sf), "pkt_len_mean").withColumn("edge", F.round("edge", 6))


@query("d16_feature_distribution_percentiles", "flows", f"""WITH {DIST}
SELECT round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50,
 round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.9), 6) AS p90 FROM c""")
def dist_percentiles(spark, sf):
    one = distribution.bounds_and_percentiles(views.flows(spark, sf), "pkt_len_mean")
    return one.select(*[F.round(f"p{p}", 6).alias(f"p{p}") for p in (10, 25, 50, 75, 90)])


@query("d16_feature_distribution_moments", "flows", f"""WITH {DIST}
SELECT round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max FROM c""")
def dist_moments(spark, sf):
    m = distribution.moments(views.flows(spark, sf), "pkt_len_mean")
    return m.select(F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), F.round("min", 6).alias("min"), F.round("max", 6).alias("max"))


@query("d17_histogram_density", "flows", f"""WITH {DIST},
h AS (SELECT CAST(least(bins - 1, floor((v - lo) / (hi - lo) * bins)) AS INT) AS bin, count(*) AS count FROM c GROUP BY 1)
SELECT bin, count, round(CAST(count AS DOUBLE) / (SELECT sum(count) FROM h), 9) AS density FROM h""")
def density(spark, sf):
    h = distribution.histogram(views.flows(spark, sf), "pkt_len_mean").select("bin", "count")
    return imp.histogram_density(h).withColumn("density", F.round("density", 9))


@query("d18_normalise_importance", "telemetry importance", f"WITH {NORM} SELECT name, score, round(normalized_score, 9) AS normalized_score FROM norm")
def normalise(spark, sf):
    return norm_importance(spark, sf).withColumn("normalized_score", F.round("normalized_score", 9))


def scored(spark, sf):
    """Flows with a label and a made-up score that is right more often than not."""
    f = views.flows(spark, sf)
    score = F.round(F.col("flow_duration") / 50 * 0.6 + F.col("pkt_len_mean") / 110000 * 0.4, 3)
    return f.select("flow_key", flows.binary_label(F.col("raw_label")).alias("label"), score.alias("score"),
                    (score >= 0.5).cast("int").alias("prediction"))


SCORED = """scored AS (SELECT flow_key, CASE WHEN raw_label = 'BENIGN' THEN 0 ELSE 1 END AS label,
 round(flow_duration / 50 * 0.6::DOUBLE + pkt_len_mean / 110000 * 0.4::DOUBLE, 3) AS score,
 CASE WHEN round(flow_duration / 50 * 0.6::DOUBLE + pkt_len_mean / 110000 * 0.4::DOUBLE, 3) >= 0.5 THEN 1 ELSE 0 END AS prediction FROM flows)"""


@query("d20_confusion_matrix", "flows", f"WITH {SCORED} SELECT label, prediction, count(*) AS n FROM scored GROUP BY 1, 2")
def confusion(spark, sf):
    return evaluation.confusion_matrix(scored(spark, sf))


@query("d21_accuracy", "flows", f"WITH {SCORED} SELECT round(avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy FROM scored")
def accuracy(spark, sf):
    return evaluation.accuracy(scored(spark, sf)).select(F.round("accuracy", 9).alias("accuracy"))


@query("d22_auc_roc", "flows", f"""WITH {SCORED},
g AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY 1),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT round(CAST(sum(pos * (below + neg / CAST(2 AS DOUBLE))) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 9) AS auc FROM c""")
def auc(spark, sf):
    return evaluation.auc_roc(scored(spark, sf)).select(F.round("auc", 9).alias("auc"))


@query("d23_classification_report", "flows", f"""WITH {SCORED},
k AS (SELECT 0 AS c UNION ALL SELECT 1),
p AS (SELECT c, CAST(count(*) FILTER (label = c AND prediction = c) AS DOUBLE) AS hit, count(*) FILTER (prediction = c) AS said, count(*) FILTER (label = c) AS support FROM scored, k GROUP BY 1),
r AS (SELECT CAST(c AS VARCHAR) AS class, hit / said AS precision, hit / support AS recall, 2 * (hit / said) * (hit / support) / (hit / said + hit / support) AS f1, support FROM p),
a AS (SELECT * FROM r UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM r
 UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM r)
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM a""")
def report(spark, sf):
    rep = evaluation.classification_report(scored(spark, sf))
    return rep.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("d24_cv_summary", "flows", f"""WITH {SCORED},
m AS (SELECT CAST(concat('0x', substr(md5(flow_key), 1, 8)) AS BIGINT) % 5 AS fold, avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM scored GROUP BY 1)
SELECT round(avg(accuracy), 9) AS accuracy_mean, round(stddev_pop(accuracy), 9) AS accuracy_std FROM m""")
def cv(spark, sf):
    from vigilframe.functions.text import hash_bucket
    folds = evaluation.accuracy(scored(spark, sf).withColumn("fold", hash_bucket(F.col("flow_key"), 5)), ["fold"])
    s = evaluation.cv_summary(folds, ["accuracy"])
    return s.select(*[F.round(c, 9).alias(c) for c in s.columns])


@query("d25_dominant_vector", "telemetry", """
SELECT CAST(floor(vector + 0.5) AS INT) AS angle, count(*) AS count, arg_max(dst_ip, seq) AS geo FROM telemetry GROUP BY 1 ORDER BY 2 DESC, min(seq) LIMIT 1""")
def dominant(spark, sf):
    return threats.dominant_vector(views.telemetry(spark, sf))


@query("d26_fleet_status_counts", "host_metrics", """
WITH l AS (SELECT host, arg_max(status, seq) AS status FROM host_metrics GROUP BY 1)
SELECT count(*) FILTER (status = 'online') AS online, count(*) FILTER (status = 'warning') AS warning, count(*) FILTER (status = 'maintenance') AS maintenance FROM l""")
def fleet(spark, sf):
    return health.fleet_status_counts(health.latest_samples(views.host_metrics(spark, sf)))


@query("d27_highest_cpu_node", "host_metrics", """
SELECT host, arg_max(cpu, seq) AS cpu FROM host_metrics GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")
def busiest(spark, sf):
    return health.highest_cpu_node(health.latest_samples(views.host_metrics(spark, sf)))


@query("d28_backlog_size", "telemetry", "SELECT count(*) AS backlog FROM telemetry")
def backlog(spark, sf):
    return views.telemetry(spark, sf).agg(F.count("*").alias("backlog"))


@query("d29_event_count", "telemetry", """
SELECT coalesce(severity, 'all') AS severity, count(*) AS count FROM telemetry GROUP BY GROUPING SETS ((severity), ())""")
def event_count(spark, sf):
    per = views.telemetry(spark, sf).rollup("severity").agg(F.count("*").alias("count"))
    return per.select(F.coalesce("severity", F.lit("all")).alias("severity"), "count")


@query("d30_incidents_overview", "telemetry", f"""
WITH p AS (SELECT src_ip, label, count(*) FILTER ({ATTACK}) AS n, count(*) FILTER (confidence > 0.2 AND label = 'benign') AS fp FROM telemetry GROUP BY 1, 2)
SELECT CAST(sum(n) AS BIGINT) AS incidents_logged, count(*) FILTER (n >= 5) AS patterns_detected, CAST(sum(fp) AS BIGINT) AS false_positives FROM p""")
def incidents(spark, sf):
    return summary.incidents_overview(attack_telemetry(spark, sf), F.col("confidence") > 0.2)


@query("d31_attack_trends", "telemetry", f"""
WITH s AS (SELECT unnest(generate_series({ASOF} - INTERVAL 29 MINUTE, {ASOF}, INTERVAL 1 MINUTE)) AS minute),
c AS (SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM telemetry WHERE {ATTACK} AND ts >= {ASOF} - INTERVAL 30 MINUTE GROUP BY 1),
f AS (SELECT minute, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (minute))
SELECT a.minute, a.n AS attacks, a.n - b.n AS change FROM f a JOIN f b ON b.minute = a.minute - INTERVAL 15 MINUTE""")
def trends(spark, sf):
    return summary.attack_trends(attack_telemetry(spark, sf), views.AS_OF)


@query("d32_feed_summary", "telemetry", "SELECT count(*) AS messages, arg_max(ts, seq) AS newest FROM telemetry")
def feed(spark, sf):
    return summary.feed_summary(views.telemetry(spark, sf))
