"""Sorts, limits and top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.operators import importance as imp
from vigilframe.operators import logs, summary, threats
from vigilframe.plans.aggregates import ATTACK, PARSED, parsed
from vigilframe.plans.lookups import NORM, TOPIP, WEIGHTED, WIN, attack_telemetry, baselines, norm_importance, observations
from vigilframe.plans.registry import query
from vigilframe.plans.scalar import ASOF, PSEUDO, PSEUDO_LAT, PSEUDO_LON
from vigilframe.sources import views


@query("f1_top_k", "log_lines", f"""WITH {PARSED}
SELECT src_ip, count(*) AS count FROM parsed WHERE category = 'attack' AND src_ip IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, min(seq) LIMIT 10""")
def top_k(spark, sf):
    return summary.top_k(parsed(spark, sf).filter("category = 'attack'"), "src_ip", 10, newest_first=False)


@query("f2_top_attackers", "telemetry", f"""
SELECT src_ip AS ip, count(*) AS count, arg_max(dst_ip, seq) AS geo FROM telemetry WHERE {ATTACK} GROUP BY 1 ORDER BY 2 DESC, min(seq) LIMIT 25""")
def attackers(spark, sf):
    top = summary.top_k(attack_telemetry(spark, sf).filter("attack"), "src_ip", 25, newest_first=False, extra=[F.max_by("dst_ip", "seq").alias("geo")])
    return top.withColumnRenamed("src_ip", "ip")


@query("f3_top_ips_from_alerts", "telemetry", """
SELECT CASE WHEN seq % 12 = 0 THEN 'Unknown' ELSE src_ip END AS ip, count(*) AS count FROM telemetry WHERE severity = 'ALERT' GROUP BY 1""")
def alert_ips(spark, sf):
    a = threats.alerts_only(views.telemetry(spark, sf)).withColumn("src_ip", F.when(F.col("seq") % 12 != 0, F.col("src_ip")))
    return summary.top_k(a.withColumn("ip", F.coalesce("src_ip", F.lit("Unknown"))), "ip", None, newest_first=False)


@query("f4_attack_history", "log_lines", f"""WITH {PARSED}
SELECT seq, ts, src_ip FROM parsed WHERE category = 'attack' ORDER BY seq DESC LIMIT 50""")
def history(spark, sf):
    return logs.attack_history(parsed(spark, sf), 50).select("seq", "ts", "src_ip")


def contributions(spark, sf):
    return imp.weighted_attribution(views.importance(spark, sf), baselines(spark, sf), observations(spark, sf))


@query("f5_top_attributions", "telemetry importance", f"""WITH {WEIGHTED.strip()},
r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(value) DESC, feature) AS rank FROM contributions)
SELECT row_id, feature, value, CAST(rank AS INT) AS rank, value >= 0 AS positive FROM r WHERE rank <= 8""")
def top_attr(spark, sf):
    return imp.top_attributions(contributions(spark, sf))


@query("f6_top_feature_signals", "telemetry importance", f"""WITH {NORM}
SELECT CAST(row_number() OVER (ORDER BY normalized_score DESC, name) AS INT) AS rank, name AS feature,
 CASE WHEN normalized_score > 0.65 THEN 'rising' ELSE 'elevated' END AS signal, round(normalized_score, 9) AS score FROM norm ORDER BY 1 LIMIT 12""")
def signals(spark, sf):
    return imp.top_feature_signals(norm_importance(spark, sf), 12).withColumn("score", F.round("score", 9))


@query("f7_threat_table_from_summary", "telemetry", f"""WITH {WIN}, {TOPIP},
w AS (SELECT src_ip AS ip, count / (SELECT CAST(sum(count) AS DOUBLE) FROM top) AS w FROM top)
SELECT ip, (SELECT proto FROM win GROUP BY 1 ORDER BY count(*) DESC, max(seq) DESC LIMIT 1) || ' ' || (SELECT CAST(dst_port AS VARCHAR) FROM win GROUP BY 1 ORDER BY count(*) DESC, max(seq) DESC LIMIT 1) AS threat_type,
 CAST(round(w * 100) AS INT) AS confidence, printf('Weight %.1f%%', w * 100) AS geo,
 CASE WHEN w > 0.35 THEN 'CRITICAL' WHEN w > 0.2 THEN 'WARNING' ELSE 'ONLINE' END AS status FROM w""")
def table_summary(spark, sf):
    return summary.threat_table_from_summary(views.telemetry(spark, sf), views.AS_OF, 5)


GEO = f"""{PSEUDO}
SELECT concat('geo-', ip) AS id, ip, {PSEUDO_LAT} AS latitude, {PSEUDO_LON} AS longitude, count AS intensity FROM seed"""


@query("f8_geo_points", "telemetry", f"""WITH {WIN}, {TOPIP},
ranked AS (SELECT src_ip AS ip, count, row_number() OVER (ORDER BY count DESC, src_ip) - 1 AS rank FROM top), {GEO}""")
def geo_points(spark, sf):
    return summary.geo_points(summary.top_k(threats.lookback(views.telemetry(spark, sf), views.AS_OF, 5), "src_ip"))


@query("f9_top10_importance", "importance", "SELECT name, round(score * 100, 1) AS percent FROM importance ORDER BY score DESC, name LIMIT 10")
def top10(spark, sf):
    return imp.top10_importance(views.importance(spark, sf))


@query("f10_first_n_instances", "flows", """
SELECT row_id, flow_key, flow_duration, pkt_len_mean FROM flows ORDER BY row_id, flow_key LIMIT 5""")
def first_n(spark, sf):
    return views.flows(spark, sf).select("row_id", "flow_key", "flow_duration", "pkt_len_mean").orderBy("row_id", "flow_key").limit(5)


@query("f11_threat_table_from_rows", "telemetry", """
SELECT CASE WHEN seq % 9 = 0 THEN concat('unknown-', CAST(seq AS VARCHAR)) ELSE src_ip END AS ip, CASE WHEN seq % 8 = 0 THEN 'Unknown' ELSE label END AS threat_type,
 CAST(floor(CASE WHEN seq % 7 = 0 THEN 0 ELSE confidence * 100 END + 0.5) AS INT) AS confidence, CASE WHEN seq % 6 = 0 THEN '—' ELSE dst_ip END AS geo,
 CASE WHEN seq % 5 = 0 THEN 'ONLINE' ELSE status END AS status, seq FROM telemetry ORDER BY 3 DESC, seq LIMIT 40""")
def table_rows(spark, sf):
    some = lambda m, c: F.when(F.col("seq") % m != 0, c)
    t = views.telemetry(spark, sf).select(
        "seq", some(9, F.col("src_ip")).alias("ip"), some(8, F.col("label")).alias("threat_type"), some(7, F.col("confidence") * 100).alias("confidence"),
        some(6, F.col("dst_ip")).alias("geo"), some(5, F.col("status")).alias("status"))
    return summary.threat_table_from_rows(t)


@query("f12_geo_top", "telemetry", f"""
WITH t AS (SELECT src_ip AS ip, count(*) AS count FROM telemetry WHERE src_ip IS NOT NULL GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY count DESC, ip) - 1 AS rank FROM t), {PSEUDO}
SELECT concat('geo-', ip) AS id, ip, {PSEUDO_LAT} AS latitude, {PSEUDO_LON} AS longitude,
 round(greatest(0.2::DOUBLE, least(1.0::DOUBLE, count / CAST((SELECT max(count) FROM t) AS DOUBLE))), 9) AS intensity FROM seed ORDER BY count DESC, ip LIMIT 30""")
def geo_top(spark, sf):
    # The list is cut once, in the order that the points are numbered and kept in.
    per = views.telemetry(spark, sf).where("src_ip is not null").groupBy("src_ip").agg(F.count("*").alias("count"))
    points = summary.geo_points(per.orderBy(F.col("count").desc(), "src_ip").limit(30))
    return summary.geo_top(points).withColumn("intensity", F.round("intensity", 9))


@query("f12_geo_live", "telemetry", f"""
WITH n AS (SELECT seq, src_ip AS ip FROM telemetry WHERE severity = 'ALERT' ORDER BY seq DESC LIMIT 25),
ranked AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS rank FROM n), {PSEUDO}
SELECT seq, ip, {PSEUDO_LAT} AS latitude, {PSEUDO_LON} AS longitude, rank >= 15 AS in_table FROM seed""")
def geo_live(spark, sf):
    return summary.live_points(threats.alerts_only(views.telemetry(spark, sf)))
