"""Unions, de-duplication and exact hash-ordered samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.operators import exact, flows, ingest, narrative
from vigilframe.plans.registry import query
from vigilframe.sources import views


@query("g1_union_files", "flows", """
SELECT flow_key, flow_duration, CAST(NULL AS DOUBLE) AS bwd_iat FROM flows WHERE proto_txt = 'O'
UNION ALL SELECT flow_key, NULL, bwd_iat FROM flows WHERE proto_txt <> 'O'""")
def union_files(spark, sf):
    f = views.flows(spark, sf)
    a = f.filter("proto_txt = 'O'").select("flow_key", "flow_duration")
    b = f.filter("proto_txt <> 'O'").select("flow_key", "bwd_iat")
    return a.unionByName(b, allowMissingColumns=True)


@query("g2_drop_duplicates", "flows", "SELECT DISTINCT flow_duration, bwd_iat, dst_port, proto_txt, raw_label FROM flows")
def duplicates(spark, sf):
    return views.flows(spark, sf).select("flow_duration", "bwd_iat", "dst_port", "proto_txt", "raw_label").dropDuplicates()


RANK = "row_number() OVER (PARTITION BY {c} ORDER BY md5(concat_ws('|', '42', {k})), {k}) AS r, count(*) OVER (PARTITION BY {c}) AS n"


@query("g3_sample_per_file", "flows", f"""
WITH r AS (SELECT flow_key, day, year(day) AS file_id, {RANK.format(c='year(day)', k='flow_key')} FROM flows)
SELECT flow_key, CAST(file_id AS INT) AS file_id FROM r WHERE r <= round(n * 0.2::DOUBLE)""")
def sample_file(spark, sf):
    f = views.flows(spark, sf).select("flow_key", F.year("day").alias("file_id"))
    return exact.sample_exact(f, ["file_id"], ["flow_key"], 0.2)


@query("g4_sample_n", "flows", """
SELECT flow_key, flow_duration FROM flows ORDER BY md5(concat_ws('|', '42', flow_key)), flow_key LIMIT 512""")
def sample_n(spark, sf):
    return exact.sample_n(views.flows(spark, sf).select("flow_key", "flow_duration"), ["flow_key"], 512)


@query("g5_dedup_events", "telemetry", """
SELECT concat('e', CAST(seq // 3 AS VARCHAR)) AS id, min(seq) AS seq, arg_min(src_ip, seq) AS src_ip FROM telemetry GROUP BY 1""")
def dedup(spark, sf):
    t = views.telemetry(spark, sf).select(F.concat(F.lit("e"), F.floor(F.col("seq") / 3).cast("string")).alias("id"), "seq", "src_ip")
    return ingest.dedup_events(t)


@query("g6_append_capped", "telemetry", """
SELECT seq, label FROM (SELECT seq, label, 0 AS side FROM (SELECT * FROM telemetry WHERE severity = 'ALERT' ORDER BY seq DESC LIMIT 5)
 UNION ALL SELECT seq, label, 1 FROM (SELECT * FROM telemetry WHERE severity = 'HIGH' ORDER BY seq DESC LIMIT 20)) ORDER BY side, seq LIMIT 12""")
def capped(spark, sf):
    t = views.telemetry(spark, sf).select("seq", "label", "severity")
    newest = lambda s, n: t.filter(F.col("severity") == s).orderBy(F.col("seq").desc()).limit(n).drop("severity")
    return narrative.append_capped(newest("ALERT", 5), newest("HIGH", 20), "seq")


LABELLED = "lab AS (SELECT flow_key, CASE WHEN raw_label = 'BENIGN' THEN 0 ELSE 1 END AS label FROM flows)"


def labelled(spark, sf):
    return views.flows(spark, sf).select("flow_key", flows.binary_label(F.col("raw_label")).alias("label"))


@query("g7_stratified_split", "flows", f"""
WITH {LABELLED}, r AS (SELECT *, {RANK.format(c='label', k='flow_key')} FROM lab)
SELECT flow_key, label, CASE WHEN r <= round(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM r""")
def split(spark, sf):
    return exact.stratified_split(labelled(spark, sf), "label", ["flow_key"])


@query("g8_stratified_kfold", "flows", f"""
WITH {LABELLED}, r AS (SELECT *, {RANK.format(c='label', k='flow_key')} FROM lab)
SELECT flow_key, label, CAST((CASE WHEN r > floor(n * 1 / 5) THEN 1 ELSE 0 END) + (CASE WHEN r > floor(n * 2 / 5) THEN 1 ELSE 0 END)
 + (CASE WHEN r > floor(n * 3 / 5) THEN 1 ELSE 0 END) + (CASE WHEN r > floor(n * 4 / 5) THEN 1 ELSE 0 END) AS INT) AS fold FROM r""")
def folds(spark, sf):
    return exact.stratified_folds(labelled(spark, sf), "label", ["flow_key"])
