"""Scans, sources and sinks. Input files are written from the given tables first."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from vigilframe.functions import logtext
from vigilframe.operators import distribution, ingest, logs, ordering
from vigilframe.operators import flows as flowops
from vigilframe.operators import importance as imp
from vigilframe.plans.lookups import NORM, attack_telemetry, norm_importance
from vigilframe.plans.registry import query
from vigilframe.plans.scalar import OBJ, RAWCTE
from vigilframe.session import fresh_path
from vigilframe.sources import readers, views, writers


@query("a1_scan_flow_csvs", "flows", "SELECT flow_key, flow_duration, pkt_len_mean, dst_port, raw_label FROM flows")
def scan_csvs(spark, sf):
    path = fresh_path(spark, "csv")
    cols = ["flow_key", "flow_duration", "pkt_len_mean", "dst_port", "raw_label"]
    source = views.flows(spark, sf).select(*cols)
    source.write.option("header", True).csv(path)
    return readers.scan_flow_csvs(spark, path, schema=source.schema).select(*cols)


@query("a2_scan_json_events", "raw_events", f"{RAWCTE} SELECT seq, len(json_keys(j)) AS fields FROM objs")
def scan_json(spark, sf):
    found = ingest.scan_json_events(views.raw_events(spark, sf))
    return found.select("seq", F.size(F.json_object_keys("raw")).cast("bigint").alias("fields"))


@query("a3_scan_json_lenient", "raw_events", f"""
SELECT seq, CASE WHEN json_valid(raw) THEN raw ELSE concat('{{"raw":"', raw, '"}}') END AS payload FROM raw_events""")
def scan_lenient(spark, sf):
    return ingest.scan_json_lenient(views.raw_events(spark, sf)).select("seq", "payload")


@query("a4_newest_n", "telemetry", "SELECT seq, ts, src_ip FROM telemetry ORDER BY seq DESC LIMIT 100")
def newest(spark, sf):
    return ordering.newest_n(views.telemetry(spark, sf).select("seq", "ts", "src_ip"), 100)


@query("a5_recent_threats", "raw_events", f"""
WITH n AS (SELECT seq, raw FROM raw_events ORDER BY seq DESC LIMIT 200) SELECT seq, raw FROM n WHERE {OBJ.replace('raw END', '1 END')} = 1""")
def recent(spark, sf):
    held = ordering.newest_n_in_order(views.raw_events(spark, sf), 200)
    return ingest.scan_json_events(held).select("seq", "raw").orderBy("seq")


def log_folder(spark, sf):
    """Two generations of log files: the first half hour, then everything else."""
    path = fresh_path(spark, "logs")
    lines = views.log_lines(spark, sf)
    early = F.col("line") < "[2024-01-01 00:30"
    writers.write_log_lines(lines.filter(early), path)
    writers.write_log_lines(lines.filter(~early), path)
    return path


@query("a6_read_log_dir", "log_lines", "SELECT line FROM log_lines")
def read_logs(spark, sf):
    return readers.read_log_dir(spark, log_folder(spark, sf), "*.txt").select("line")


LAST_MINUTE = "line >= '[2024-01-01 00:59'"


def log_files(spark, sf):
    """Log files in order of time; the last minute's lines are the newest file, in order."""
    path, lines = fresh_path(spark, "logs"), views.log_lines(spark, sf)
    writers.write_log_lines(lines.where(f"NOT ({LAST_MINUTE})"), path)
    time.sleep(1.1)  # file times may be whole seconds
    writers.write_log_lines(lines.where(LAST_MINUTE).coalesce(1).sortWithinPartitions("seq"), path)
    return path


@query("a7_latest_log_only", "log_lines", f"SELECT line FROM log_lines WHERE {LAST_MINUTE}")
def latest_log(spark, sf):
    return readers.latest_log_only(spark, log_files(spark, sf), "*.txt").select("line")


@query("a8_last_lines", "log_lines", f"""
SELECT line, CAST(row_number() OVER (ORDER BY seq DESC) AS INT) AS from_end FROM log_lines WHERE {LAST_MINUTE} ORDER BY seq DESC LIMIT 200""")
def last_lines(spark, sf):
    """The last lines of the newest file."""
    lines = readers.latest_log_only(spark, log_files(spark, sf), "*.txt")
    return readers.last_lines(lines, 200).select("line", "from_end")


@query("a9_scan_importance_csv", "importance_lines", """
SELECT trim(split_part(line, ',', 1)) AS name, TRY_CAST(trim(split_part(line, ',', 2)) AS DOUBLE) AS score
FROM importance_lines WHERE TRY_CAST(trim(split_part(line, ',', 2)) AS DOUBLE) IS NOT NULL""")
def importance_csv(spark, sf):
    path = fresh_path(spark, "importance")
    writers.write_log_lines(views.importance_lines(spark, sf), path)
    return readers.scan_importance_csv(spark, path)


@query("a10_scan_importance_json", "telemetry", """
SELECT seq, 0 AS pos, 'a' AS name, CAST(k AS DOUBLE) AS score FROM telemetry WHERE seq % 4 IN (0, 1, 2)
UNION ALL SELECT seq, 1, label, CAST(2.5 AS DOUBLE) FROM telemetry WHERE seq % 4 IN (0, 1)
UNION ALL SELECT seq, 0, 'x', CAST(0.5 AS DOUBLE) FROM telemetry WHERE seq % 4 = 3
UNION ALL SELECT seq, 1, proto, CAST(0.5 AS DOUBLE) FROM telemetry WHERE seq % 4 = 3""")
def importance_json(spark, sf):
    k, label = F.col("k").cast("string"), F.col("label")
    m = F.col("seq") % 4
    raw = (
        F.when(m == 0, F.concat(F.lit('{"feature_importance":[{"feature":"a","importance":'), k, F.lit('},{"name":"'), label, F.lit('","value":2.5},{"name":"none"}]}')))
        .when(m == 1, F.concat(F.lit('{"importance":[["a",'), k, F.lit('],["'), label, F.lit('",2.5],["short"]]}')))
        .when(m == 2, F.concat(F.lit('{"importance":[{"name":"a","importance":'), k, F.lit("}]}")))
        .otherwise(F.concat(F.lit('{"realtime_model":{"features":["x","'), F.col("proto"), F.lit('"]}}')))
    )
    return imp.parse_importance_json(views.telemetry(spark, sf).select("seq", raw.alias("raw")), ["seq"])


@query("a11_scan_detections_log", "telemetry", """
SELECT seq, strftime(ts, '%H:%M:%S') AS time, 'BLOCK_FAILED' AS type, src_ip AS ip, concat(proto, ' ', CAST(dst_port AS VARCHAR)) AS rest
FROM telemetry WHERE seq % 6 <> 0 ORDER BY seq DESC LIMIT 25""")
def detections(spark, sf):
    line = F.when(F.col("seq") % 6 == 0, "broken line").otherwise(
        F.concat_ws(" ", F.date_format("ts", "HH:mm:ss"), F.lit("BLOCK_FAILED"), "src_ip", "proto", F.col("dst_port").cast("string")))
    return readers.scan_detections(views.telemetry(spark, sf).select("seq", line.alias("line")))


@query("a12_write_features_labels", "flows", """
SELECT flow_key, flow_duration, pkt_len_mean, bwd_iat, CASE WHEN raw_label = 'BENIGN' THEN 0 ELSE 1 END AS label FROM flows""")
def features_labels(spark, sf):
    path = fresh_path(spark, "features")
    rows = views.flows(spark, sf).withColumn("label", flowops.binary_label(F.col("raw_label")))
    writers.write_features_labels(rows, path, ["flow_duration", "pkt_len_mean", "bwd_iat"], "label", keep=["flow_key"])
    return spark.read.parquet(path)


@query("a13_write_metrics_json", "flows", """
SELECT count(*) AS total_rows, count(*) FILTER (raw_label = 'BENIGN') AS benign_rows, CAST(0.2 AS DOUBLE) AS sample_fraction FROM flows""")
def metrics_json(spark, sf):
    path = fresh_path(spark, "metrics")
    f = views.flows(spark, sf)
    doc = f.agg(F.count("*").alias("total_rows"), F.count_if(F.col("raw_label") == "BENIGN").alias("benign_rows"), F.lit(0.2).alias("sample_fraction"))
    writers.write_metrics_json(doc, path)
    return spark.read.schema(doc.schema).json(path)


@query("a14_write_importance_csv", "telemetry importance", f"WITH {NORM} SELECT name, score, round(normalized_score, 9) AS normalized_score FROM norm")
def write_importance(spark, sf):
    path = fresh_path(spark, "importance")
    writers.write_importance_csv(norm_importance(spark, sf).withColumn("normalized_score", F.round("normalized_score", 9)), path)
    return spark.read.option("header", True).schema("name string, score double, normalized_score double").csv(path)


@query("a15_write_distribution_csv", "flows", """
WITH f AS (SELECT flow_duration AS x FROM flows), b AS (SELECT quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM f),
h AS (SELECT CAST(least(29, floor((greatest(lo, least(hi, x)) - lo) / (hi - lo) * 30)) AS INT) AS bin, count(*) AS count FROM f, b GROUP BY 1)
SELECT round(lo + r.bin * ((hi - lo) / 30), 6) AS bucket, coalesce(count, 0) AS count FROM (SELECT unnest(range(0, 30)) AS bin) r LEFT JOIN h ON h.bin = r.bin, b""")
def write_distribution(spark, sf):
    path = fresh_path(spark, "distribution")
    writers.write_distribution_csv(distribution.histogram(views.flows(spark, sf), "flow_duration").withColumn("edge", F.round("edge", 6)), path)
    return spark.read.option("header", True).schema("bucket double, count bigint").csv(path)


@query("a17_write_detection_log", "telemetry", """
SELECT concat(strftime(ts, '[%Y-%m-%d %H:%M:%S] '), CASE WHEN is_attack THEN concat('⚠️ [ATTACK DETECTED] Src IP: ', src_ip, ' | ') ELSE '✅ Normal Traffic | ' END,
 'Src Port: ', CAST(src_port AS VARCHAR), ' | Dst Port: ', CAST(dst_port AS VARCHAR)) AS line FROM telemetry""")
def write_log(spark, sf):
    path = fresh_path(spark, "logs")
    t = views.telemetry(spark, sf)
    line = logtext.detection_line(F.col("ts"), F.col("is_attack"), F.col("src_ip"), F.col("src_port"), F.col("dst_port"))
    writers.write_log_lines(t.select(line.alias("line")), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


BLOCK = """
SELECT src_ip, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS hits FROM telemetry
WHERE {cond} GROUP BY 1"""


@query("a18_blocklist_sink", "telemetry", BLOCK.format(cond="(is_attack OR contains(lower(label), 'attack') OR contains(lower(label), 'malicious') OR severity IN ('ALERT','CRITICAL','HIGH')) AND seq % 9 <> 0"))
def blocklist(spark, sf):
    unknown = F.when(F.col("seq") % 9 == 0, "Unknown").otherwise(F.col("src_ip"))
    return logs.blocklist(attack_telemetry(spark, sf).withColumn("src_ip", unknown))
