"""Keyed lookups written as joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.operators import importance as imp
from vigilframe.operators import summary, threats
from vigilframe.plans.registry import query
from vigilframe.plans.scalar import ASOF
from vigilframe.sources import views


def attack_telemetry(spark, sf):
    return summary.with_attack(views.telemetry(spark, sf))


def norm_importance(spark, sf):
    return imp.normalise_importance(views.importance(spark, sf))


NORM = "norm AS (SELECT name, score, abs(score) / (SELECT max(abs(score)) FROM importance) AS normalized_score FROM importance)"
WIN = f"win AS (SELECT *, (is_attack OR contains(lower(label), 'attack') OR contains(lower(label), 'malicious') OR severity IN ('ALERT','CRITICAL','HIGH')) AS attack FROM telemetry WHERE ts >= {ASOF} - INTERVAL 5 MINUTE)"
TOPIP = "top AS (SELECT src_ip, count(*) AS count, max(seq) AS last FROM win GROUP BY 1 ORDER BY 2 DESC, 3 DESC LIMIT 10)"


@query("c1_features_labels", "flows", """
SELECT flow_key, flow_duration, pkt_len_mean, CASE WHEN raw_label = 'BENIGN' THEN 0 ELSE 1 END AS label FROM flows""")
def features_labels(spark, sf):
    from vigilframe.operators.flows import binary_label, join_labels
    f = views.flows(spark, sf)
    return join_labels(f.select("flow_key", "flow_duration", "pkt_len_mean"),
                       f.select("flow_key", binary_label(F.col("raw_label")).alias("label")), "flow_key")


def observations(spark, sf):
    """Long (row, name, value): each event reports its own traffic kind, some report none."""
    t = views.telemetry(spark, sf)
    name = F.concat_ws("_", F.lower("proto"), F.col("dst_port").cast("string"))
    return t.select(F.col("seq").alias("row_id"), name.alias("name"), F.col("vector").alias("value"))


def baselines(spark, sf):
    t = views.telemetry(spark, sf).filter("dst_port <> 22")
    name = F.concat_ws("_", F.lower("proto"), F.col("dst_port").cast("string"))
    return t.groupBy(name.alias("name")).agg(F.round(F.avg("vector"), 2).alias("value"))


WEIGHTED = """
base AS (SELECT concat(lower(proto), '_', CAST(dst_port AS VARCHAR)) AS name, round(avg(vector), 2) AS value FROM telemetry WHERE dst_port <> 22 GROUP BY 1),
w AS (SELECT i.name, score, coalesce(b.value, 0) AS baseline FROM importance i LEFT JOIN base b USING (name)),
obs AS (SELECT seq AS row_id, concat(lower(proto), '_', CAST(dst_port AS VARCHAR)) AS name, vector AS value FROM telemetry),
contributions AS (SELECT r.row_id, w.name AS feature, round((coalesce(o.value, w.baseline) - w.baseline) * w.score, 6) + 0 AS value
 FROM (SELECT DISTINCT row_id FROM obs) r CROSS JOIN w LEFT JOIN obs o ON o.row_id = r.row_id AND o.name = w.name)"""


@query("c2_importance_baseline_observation", "telemetry importance", f"WITH {WEIGHTED.strip()} SELECT * FROM contributions")
def weighted(spark, sf):
    return imp.weighted_attribution(views.importance(spark, sf), baselines(spark, sf), observations(spark, sf))


@query("c3_timeline_spine", "telemetry", f"""
WITH spine AS (SELECT unnest(generate_series({ASOF} - INTERVAL 29 MINUTE, {ASOF}, INTERVAL 1 MINUTE)) AS minute),
c AS (SELECT date_trunc('minute', ts) AS minute, count(*) AS count FROM telemetry WHERE ts >= {ASOF} - INTERVAL 30 MINUTE GROUP BY 1)
SELECT minute, coalesce(count, 0) AS count FROM spine LEFT JOIN c USING (minute)""")
def spine(spark, sf):
    return summary.timeline(views.telemetry(spark, sf), views.AS_OF, 30)


@query("c4_previous_status", "telemetry", """
SELECT seq, src_ip, lag(status) OVER (PARTITION BY src_ip ORDER BY seq) AS previous FROM telemetry""")
def previous_status(spark, sf):
    return threats.status_transition(views.telemetry(spark, sf)).select("seq", "src_ip", "previous")


@query("c5_top_ip_share", "telemetry", f"""
WITH {WIN}, {TOPIP} SELECT src_ip, count, count / (SELECT CAST(sum(count) AS DOUBLE) FROM top) AS share FROM top""")
def share(spark, sf):
    top = summary.top_k(threats.lookback(views.telemetry(spark, sf), views.AS_OF, 5), "src_ip")
    return summary.share_of_total(top, top.agg(F.sum("count")))


@query("c6_top_ip_peak", "telemetry", f"""
WITH {WIN}, {TOPIP} SELECT src_ip, count, least(100, count / (SELECT CAST(max(count) AS DOUBLE) FROM top) * 100) AS percent FROM top""")
def peak(spark, sf):
    return summary.bar_percent(summary.top_k(threats.lookback(views.telemetry(spark, sf), views.AS_OF, 5), "src_ip"))


@query("c7_merge_feature_sources", "telemetry importance", """
WITH s AS (SELECT label AS name, CAST(count(*) AS DOUBLE) * 100 / (SELECT count(*) FROM telemetry) AS importance FROM telemetry GROUP BY 1)
SELECT name, round(CASE WHEN importance > 1 THEN importance / 100 ELSE importance END, 9) AS importance FROM s""")
def merge_sources(spark, sf):
    t = views.telemetry(spark, sf)
    total = t.agg(F.count("*")).scalar()
    given = t.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")).withColumn("_t", total).select(
        "name", (F.col("n") * 100.0 / F.col("_t")).alias("importance"))
    merged = imp.merge_feature_sources(given, views.importance(spark, sf).withColumnRenamed("score", "importance"))
    return merged.withColumn("importance", F.round("importance", 9))


@query("c8_source_fallback", "telemetry", """
SELECT src_ip, count(*) AS count FROM telemetry WHERE severity = 'ALERT' GROUP BY 1""")
def fallback(spark, sf):
    t = views.telemetry(spark, sf)
    per = lambda d: d.groupBy("src_ip").agg(F.count("*").alias("count"))
    return summary.source_fallback(per(t.filter("severity = 'FATAL'")), per(threats.alerts_only(t)), per(t))


@query("c9_dashboard_composite")
def composite(spark, sf):
    from vigilframe.operators.dashboard import dashboard
    return dashboard(attack_telemetry(spark, sf), views.host_metrics(spark, sf), views.importance(spark, sf), views.AS_OF, 5)


@query("c11_importance_delta", "telemetry importance", f"""
WITH {NORM}, old AS (SELECT concat(lower(proto), '_', CAST(dst_port AS VARCHAR)) AS name, avg(k) AS score FROM telemetry WHERE dst_port <> 80 AND ts < TIMESTAMP '2024-01-01 00:30:00' GROUP BY 1),
prev AS (SELECT name, abs(score) / (SELECT max(abs(score)) FROM old) AS normalized_score FROM old)
SELECT name, round(norm.normalized_score, 9) AS normalized_score, round(coalesce(norm.normalized_score - prev.normalized_score, 0), 9) AS delta
FROM norm LEFT JOIN prev USING (name)""")
def delta(spark, sf):
    t = views.telemetry(spark, sf).filter("dst_port <> 80 AND ts < TIMESTAMP_NTZ '2024-01-01 00:30:00'")
    old = t.groupBy(F.concat_ws("_", F.lower("proto"), F.col("dst_port").cast("string")).alias("name")).agg(F.avg("k").alias("score"))
    out = imp.importance_delta(norm_importance(spark, sf), imp.normalise_importance(old))
    return out.select("name", F.round("normalized_score", 9).alias("normalized_score"), F.round("delta", 9).alias("delta"))


@query("c12_merge_kpis", "telemetry", f"""
WITH l AS (SELECT src_ip, arg_max(status, seq) AS status FROM telemetry GROUP BY 1)
SELECT count(*) FILTER (status = 'Active') AS active_threats, count(*) FILTER (status = 'Blocked') AS blocked_ips,
 greatest(count(*) FILTER (status <> 'Blocked'), (SELECT count(DISTINCT src_ip) FROM telemetry WHERE severity = 'ALERT')) AS suspicious_ips,
 (SELECT round(avg(confidence), 2) FROM telemetry) AS avg_confidence FROM l""")
def kpis(spark, sf):
    t = views.telemetry(spark, sf)
    return summary.merge_kpis(threats.threat_stats(t), summary.live_alert_kpis(threats.alerts_only(t)))
