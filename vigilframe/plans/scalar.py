"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.functions import bands, coerce, geo, logtext, text
from vigilframe.operators import flows as flowops
from vigilframe.operators import health, ingest, narrative, ordering, threats
from vigilframe.plans.registry import query
from vigilframe.sources import views

ASOF = f"TIMESTAMP '{views.AS_OF}'"


def events_of(spark, sf):
    return ingest.scan_json_events(views.raw_events(spark, sf))


OBJ = "CASE WHEN json_valid(raw) AND raw LIKE '{%' THEN raw END"


def first_json(names, cond="json_type(j, {p}) = 'VARCHAR' AND json_extract_string(j, {p}) <> ''", wrap="json_extract_string(j, {p})"):
    parts = []
    for n in names:
        path = "'$." + ".".join(f'"{x}"' for x in n.split("/")) + "'"
        parts.append(f"CASE WHEN {cond.format(p=path)} THEN {wrap.format(p=path)} END")
    return "coalesce(" + ", ".join(parts) + ")"


RAWCTE = f"WITH ev AS (SELECT seq, {OBJ} AS j FROM raw_events), objs AS (SELECT seq, j FROM ev WHERE j IS NOT NULL) "


@query("b1_validate_events", "inbound", """
SELECT seq, concat_ws(',',
  CASE WHEN NOT src_port BETWEEN 0 AND 65535 THEN 'src_port_range' END,
  CASE WHEN NOT dst_port BETWEEN 0 AND 65535 THEN 'dst_port_range' END,
  CASE WHEN src_ip = 'not-an-ip-address' THEN 'src_ip_invalid' END,
  CASE WHEN dst_ip = '192.168.0.300' THEN 'dst_ip_invalid' END,
  CASE WHEN length(proto) > 32 THEN 'proto_too_long' END,
  CASE WHEN length(severity) > 32 THEN 'severity_too_long' END,
  CASE WHEN length(message) > 2048 THEN 'message_too_long' END) AS errors,
  seq % 83 <> 0 AND seq % 89 <> 0 AND seq % 97 <> 0 AND seq % 79 <> 0 AND seq % 73 <> 0 AND seq % 107 <> 0 AS accepted
FROM inbound""")
def validate(spark, sf):
    checked = ingest.validate_events(views.inbound(spark, sf))
    return checked.select("seq", F.array_join("errors", ",").alias("errors"), "accepted")


@query("b2_is_valid_ip", "inbound", """
SELECT seq, src_ip, dst_ip, src_ip IS NULL OR src_ip <> 'not-an-ip-address' AS src_ok,
  dst_ip <> '192.168.0.300' AS dst_ok FROM inbound""")
def valid_ip(spark, sf):
    return views.inbound(spark, sf).select(
        "seq", "src_ip", "dst_ip", coerce.is_valid_ip(F.col("src_ip")).alias("src_ok"),
        coerce.is_valid_ip(F.col("dst_ip")).alias("dst_ok"))


@query("b3_drop_heartbeats", "inbound", """
SELECT seq, message FROM inbound
WHERE NOT regexp_matches(lower(trim(coalesce(message, ''))), '^sensor auto-pulse')""")
def heartbeats(spark, sf):
    return ingest.drop_heartbeats(views.inbound(spark, sf), producer="Sensor").select("seq", "message")


def _duck_sent(name):
    return f"coalesce(CAST(length(CAST({name} AS VARCHAR)) AS VARCHAR) || ':' || CAST({name} AS VARCHAR), '-')"


# Every fifth event has an id, and some of these repeat.
@query("b4_default_event_fields", "inbound", f"""
SELECT seq, coalesce(ts, {ASOF}) AS ts, CASE WHEN seq % 5 = 0 THEN 'given-' || CAST(seq % 500 AS VARCHAR)
  ELSE sha256(concat_ws('|', {', '.join(_duck_sent(c) for c in (*ingest.KNOWN_FIELDS, 'ts'))})) END AS id
FROM inbound""")
def defaults(spark, sf):
    given = F.when(F.col("seq") % 5 == 0, F.concat(F.lit("given-"), (F.col("seq") % 500).cast("string")))
    events = views.inbound(spark, sf).withColumn("id", given)
    return ingest.default_event_fields(events, views.as_of()).select("seq", "ts", "id")


@query("b5_keep_extras", "raw_events", RAWCTE + """,
keys AS (SELECT seq, j, unnest(json_keys(j)) AS key FROM objs)
SELECT seq, key, json_extract_string(j, '$."' || key || '"') AS value FROM keys
WHERE key NOT IN ('src_ip','dst_ip','src_port','dst_port','proto','severity','message')
  AND json_type(j, '$."' || key || '"') <> 'NULL'""")
def keep_extras(spark, sf):
    objects = ingest.scan_json_events(views.raw_events(spark, sf))
    return ingest.extras(objects).select("seq", F.explode("extras").alias("key", "value"))


@query("b6_maintenance_gate", "telemetry", """
SELECT seq, src_ip FROM telemetry WHERE (SELECT max(seq) % 2 FROM telemetry) <> 0""")
def gate(spark, sf):
    t = views.telemetry(spark, sf)
    flag = t.agg(F.when(F.max("seq") % 2 == 0, "ON").otherwise("off").alias("flag"))
    return ingest.maintenance_gate(t, flag).select("seq", "src_ip")


def _duck_time(name):
    p = f"""'$."{name}"'"""
    v = f"json_extract_string(j, {p})"
    n = f"TRY_CAST({v} AS DOUBLE)"
    return (
        f"CASE WHEN json_type(j, {p}) IN ('UBIGINT','BIGINT','DOUBLE') THEN "
        f"make_timestamp(CAST((CASE WHEN {n} > 1000000000000 THEN {n} / 1000 ELSE {n} END) * 1000000 AS BIGINT)) "
        f"WHEN json_type(j, {p}) = 'VARCHAR' THEN try_strptime(replace(replace({v}, 'T', ' '), 'Z', ''), '%Y-%m-%d %H:%M:%S') END"
    )


DUCK_TIME = "coalesce(" + ", ".join(_duck_time(n) for n in coerce.TS_FIELDS) + f", {ASOF})"
DUCK_IP = first_json((*coerce.IP_FIELDS, "source/ip"))
DUCK_PORT = first_json(
    (*coerce.PORT_FIELDS, "destination/port"),
    "(json_type(j, {p}) IN ('UBIGINT','BIGINT') OR (json_type(j, {p}) = 'VARCHAR' AND regexp_full_match(json_extract_string(j, {p}), '[0-9]+')))")
DUCK_PROTO = "coalesce(upper(" + first_json(coerce.PROTO_FIELDS) + "), 'UNKNOWN')"
_LABEL = first_json(coerce.LABEL_FIELDS, "json_extract_string(j, {p}) <> ''")
DUCK_ATTACK = (
    f"(coalesce(json_extract_string(j, '$.is_attack') = 'true', false) OR contains(lower(coalesce({_LABEL}, '')), 'attack') "
    f"OR contains(lower(coalesce({_LABEL}, '')), 'malicious') "
    "OR upper(coalesce(json_extract_string(j, '$.severity'), '')) IN ('ALERT','CRITICAL','HIGH'))")


@query("b7_coerce_event_ts", "raw_events", RAWCTE + f"SELECT seq, {DUCK_TIME} AS ts FROM objs")
def coerce_ts(spark, sf):
    return events_of(spark, sf).select("seq", coerce.event_time(F.col("event"), views.as_of()).alias("ts"))


@query("b8_extract_src_ip", "raw_events", RAWCTE + f"SELECT seq, {DUCK_IP} AS src_ip FROM objs")
def extract_ip(spark, sf):
    return events_of(spark, sf).select("seq", coerce.source_ip(F.col("event")).alias("src_ip"))


@query("b9_extract_dst_port", "raw_events", RAWCTE + f"SELECT seq, {DUCK_PORT} AS dst_port FROM objs")
def extract_port(spark, sf):
    return events_of(spark, sf).select("seq", coerce.destination_port(F.col("event")).alias("dst_port"))


@query("b10_extract_proto", "raw_events", RAWCTE + f"SELECT seq, {DUCK_PROTO} AS proto FROM objs")
def extract_proto(spark, sf):
    return events_of(spark, sf).select("seq", coerce.protocol(F.col("event")).alias("proto"))


@query("b11_is_attack", "raw_events", RAWCTE + f"SELECT seq, {DUCK_ATTACK} AS attack FROM objs")
def attack_flag(spark, sf):
    return events_of(spark, sf).select("seq", coerce.raw_is_attack(F.col("event")).alias("attack"))


@query("b12_lookback_filter", "telemetry", f"""
SELECT seq, ts, src_ip FROM telemetry WHERE ts >= {ASOF} - INTERVAL 5 MINUTE""")
def lookback(spark, sf):
    return threats.lookback(views.telemetry(spark, sf), views.AS_OF, 5).select("seq", "ts", "src_ip")


@query("b13_severity_weight", "telemetry", """
SELECT seq, CASE severity WHEN 'ALERT' THEN 5 WHEN 'WARNING' THEN 3 ELSE 1 END AS weight FROM telemetry""")
def weight(spark, sf):
    return views.telemetry(spark, sf).select("seq", coerce.severity_weight(F.col("severity"), F.col("label")).alias("weight"))


@query("b14_threat_band", "telemetry", """
SELECT seq, CASE WHEN confidence*100 >= 80 THEN 'critical' WHEN confidence*100 >= 60 THEN 'high'
 WHEN confidence*100 >= 30 THEN 'elevated' WHEN confidence*100 >= 10 THEN 'low' ELSE 'normal' END AS band FROM telemetry""")
def band(spark, sf):
    return views.telemetry(spark, sf).select("seq", bands.threat_band(F.col("confidence") * 100).alias("band"))


@query("b15_threat_band_dashboard", "telemetry", """
SELECT seq, CASE WHEN k >= 80 THEN 'critical' WHEN k >= 60 THEN 'high' ELSE 'normal' END AS dashboard_band,
 CASE WHEN k >= 80 THEN 'critical' WHEN k >= 50 THEN 'warn' ELSE 'normal' END AS metrics_band FROM telemetry""")
def band_dashboard(spark, sf):
    return views.telemetry(spark, sf).select(
        "seq", bands.threat_band_dashboard(F.col("k")).alias("dashboard_band"),
        bands.threat_band_metrics(F.col("k")).alias("metrics_band"))


@query("b16_threat_band_ui", "telemetry", """
WITH s AS (SELECT seq, k, CASE seq % 7 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'elevated' WHEN 2 THEN 'Idle' WHEN 3 THEN 'odd' END AS st FROM telemetry)
SELECT seq, CASE WHEN st = 'HIGH' THEN 'critical' WHEN st = 'elevated' THEN 'warn' WHEN st = 'Idle' THEN 'normal'
 WHEN k >= 70 THEN 'critical' WHEN k >= 30 THEN 'warn' ELSE 'normal' END AS band FROM s""")
def band_ui(spark, sf):
    m = F.col("seq") % 7
    st = F.when(m == 0, "HIGH").when(m == 1, "elevated").when(m == 2, "Idle").when(m == 3, "odd")
    return views.telemetry(spark, sf).select("seq", bands.threat_band_ui(F.col("k"), st).alias("band"))


@query("b17_rescale_index", "telemetry", """
WITH s AS (SELECT seq, k, CASE WHEN seq % 11 = 0 THEN CAST(0 AS DOUBLE) WHEN seq % 2 = 0 THEN confidence ELSE CAST(k AS DOUBLE) * 2 END AS i FROM telemetry),
c AS (SELECT seq, k, greatest(0.0::DOUBLE, least(100.0::DOUBLE, CASE WHEN i <= 1 THEN i * 100 ELSE i END)) AS x FROM s)
SELECT seq, round(CASE WHEN x = 0 AND k > 0 THEN least(100.0::DOUBLE, k * 8.5::DOUBLE) ELSE x END, 6) AS idx FROM c""")
def rescale(spark, sf):
    t = views.telemetry(spark, sf)
    i = F.when(F.col("seq") % 11 == 0, F.lit(0.0)).when(F.col("seq") % 2 == 0, F.col("confidence")).otherwise(F.col("k").cast("double") * 2)
    return t.select("seq", F.round(bands.rescale_index(i, F.col("k")), 6).alias("idx"))


@query("b18_gauge_value", "telemetry", f"""
SELECT date_trunc('minute', ts) AS minute, CAST(least(100, 10 * count(*)) AS DOUBLE) AS gauge
FROM telemetry WHERE severity = 'ALERT' GROUP BY 1""")
def gauge(spark, sf):
    alerts = threats.alerts_only(views.telemetry(spark, sf))
    per = alerts.groupBy(threats.minute(F.col("ts")).alias("minute")).agg(F.count("*").alias("n"))
    return per.select("minute", bands.gauge_value(F.col("n"), F.lit(None).cast("double")).alias("gauge"))


@query("b19_normalise_severity_ui", "telemetry", """
SELECT seq, CASE severity WHEN 'ALERT' THEN 'ALERT' WHEN 'WARNING' THEN 'WARNING' ELSE 'INFO' END AS ui_severity,
 CASE WHEN severity IN ('ALERT','CRITICAL') THEN 'alert' WHEN severity = 'WARNING' THEN 'warning' ELSE 'info' END AS log_severity FROM telemetry""")
def severity_ui(spark, sf):
    return views.telemetry(spark, sf).select(
        "seq", bands.severity_ui(F.col("severity")).alias("ui_severity"),
        bands.severity_log_view(F.col("severity")).alias("log_severity"))


@query("b20_log_view", "telemetry", """
WITH n AS (SELECT * FROM telemetry ORDER BY seq DESC LIMIT 200)
SELECT seq AS id, ts AS timestamp, coalesce(label, 'Event received') AS message,
 concat('confidence ', CAST(CAST(round(confidence * 100) AS BIGINT) AS VARCHAR), '% • src ', src_ip, ' • dst ', dst_ip) AS detail,
 CASE WHEN severity = 'ALERT' THEN 'alert' WHEN severity = 'WARNING' THEN 'warning' ELSE 'info' END AS severity
FROM n WHERE severity IN ('ALERT', 'WARNING')""")
def log_view(spark, sf):
    t = views.telemetry(spark, sf).select(
        F.col("seq").alias("id"), F.col("ts").alias("timestamp"), bands.severity_ui(F.col("severity")).alias("type"),
        F.col("label").alias("threat"), F.col("label").alias("message"), (F.col("confidence") * 100).alias("confidence"), "src_ip", "dst_ip")
    return threats.log_view(t, limit=200, show_info=False)


@query("b21_alerts_only", "telemetry", "SELECT seq, ts, src_ip FROM telemetry WHERE severity = 'ALERT'")
def alerts_only(spark, sf):
    return threats.alerts_only(views.telemetry(spark, sf)).select("seq", "ts", "src_ip")


DUCK_FULL = logtext.FULL_LINE.replace("(?i)", "")
DUCK_FULL_SQL = "'" + DUCK_FULL + "'"


def _dg(i):
    return f"nullif(regexp_extract(line, {DUCK_FULL_SQL}, {i}, 'i'), '')"


@query("b22_parse_log_line", "log_lines", f"""
SELECT seq, try_strptime({_dg(1)}, '%Y-%m-%d %H:%M:%S') AS timestamp, trim({_dg(2)}) AS traffic_type,
 {_dg(3)} AS src_ip, TRY_CAST({_dg(4)} AS INT) AS src_port, {_dg(5)} AS dst_ip, TRY_CAST({_dg(6)} AS INT) AS dst_port
FROM log_lines WHERE regexp_matches(line, {DUCK_FULL_SQL}, 'i')""")
def parse_full(spark, sf):
    lines = views.log_lines(spark, sf).withColumn("parts", logtext.full_parts(F.col("line"))).filter("parts is not null")
    return lines.select("seq", *[c.alias(n) for n, c in logtext.full_fields(F.col("parts")).items()])


@query("b23_parse_log_line_legacy", "log_lines", f"""
SELECT seq, try_strptime(nullif(regexp_extract(line, '^\\[([^\\]]*)\\]', 1), ''), '%Y-%m-%d %H:%M:%S') AS timestamp,
 CASE WHEN contains(line, ']') THEN trim(split_part(regexp_replace(line, '^[^\\]]*\\]', ''), '|', 1)) ELSE trim(line) END AS traffic_type,
 TRY_CAST(nullif(regexp_extract(line, 'Src Port:\\s*(\\d+)', 1), '') AS INT) AS src_port,
 TRY_CAST(nullif(regexp_extract(line, 'Dst Port:\\s*(\\d+)', 1), '') AS INT) AS dst_port
FROM log_lines WHERE NOT regexp_matches(line, {DUCK_FULL_SQL}, 'i')""")
def parse_legacy(spark, sf):
    lines = views.log_lines(spark, sf).filter(~logtext.matches_full(F.col("line")))
    fields = logtext.legacy_fields(F.col("line"))
    return lines.select("seq", *[fields[n].alias(n) for n in ("timestamp", "traffic_type", "src_port", "dst_port")])


@query("b24_log_category", "log_lines", """
SELECT seq, CASE WHEN contains(line, '[ATTACK DETECTED]') THEN 'attack' ELSE 'normal' END AS category FROM log_lines""")
def log_category(spark, sf):
    from vigilframe.operators import logs
    return logs.parse_lines(views.log_lines(spark, sf), views.as_of()).select("seq", "category")


@query("b25_normalise_threat_status", "telemetry", """
SELECT seq, CASE seq % 4 WHEN 0 THEN status WHEN 1 THEN status WHEN 2 THEN status ELSE 'Monitoring' END AS status FROM telemetry""")
def threat_status(spark, sf):
    m = F.col("seq") % 4
    messy = F.when(m == 0, F.upper("status")).when(m == 1, F.concat(F.lit(" "), F.lower("status"), F.lit(" "))).when(m == 2, F.col("status")).otherwise("quarantined")
    return views.telemetry(spark, sf).select("seq", bands.threat_status(messy).alias("status"))


def ui_events(spark, sf):
    t = views.telemetry(spark, sf)
    return t.select(
        "seq", F.when(F.col("seq") % 9 != 0, F.col("src_ip")).alias("ip"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.when(F.col("seq") % 8 != 0, F.col("label")).alias("threat_type"), (F.col("confidence") * 3 - 0.1).alias("confidence"),
        (F.col("vector") * 1.5).alias("vector"), F.when(F.col("seq") % 10 != 0, F.col("status")).alias("status"))


@query("b26_normalise_threat_event_ui", "telemetry", """
WITH e AS (SELECT seq, CASE WHEN seq % 9 <> 0 THEN src_ip ELSE '0.0.0.0' END AS ip, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp,
 CASE WHEN seq % 8 <> 0 THEN label ELSE 'Unknown' END AS threat_type,
 round(least(greatest(confidence * 3 - 0.1::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE), 6) AS confidence,
 round(least(greatest(vector * 1.5::DOUBLE, 0.0::DOUBLE), 360.0::DOUBLE), 6) AS vector,
 CASE WHEN seq % 10 <> 0 THEN status ELSE 'Monitoring' END AS status FROM telemetry)
SELECT seq, concat(ip, '-', timestamp) AS id, ip, timestamp, threat_type, confidence, vector, status FROM e""")
def threat_event_ui(spark, sf):
    out = threats.normalise_threat_events(ui_events(spark, sf))
    return out.withColumn("confidence", F.round("confidence", 6)).withColumn("vector", F.round("vector", 6)).select(
        "seq", "id", "ip", "timestamp", "threat_type", "confidence", "vector", "status")


@query("b27_strip_column_names", "flows", "SELECT row_id, flow_duration, dst_port, raw_label AS label_column FROM flows")
def strip_names(spark, sf):
    raw = views.flows(spark, sf).select(
        F.col("row_id").alias(" row_id"), F.col("flow_duration").alias(" flow_duration "), F.col("dst_port").alias("dst_port "), F.col("raw_label").alias(" Label"))
    tidy = flowops.strip_column_names(raw)
    return tidy.withColumnRenamed(flowops.detect_label_column(tidy), "label_column")


@query("b28_clean_numeric", "flows", """
SELECT flow_key, pkt_len_mean, CASE WHEN isnan(flow_bytes_s) OR isinf(flow_bytes_s) THEN 0 ELSE flow_bytes_s END AS flow_bytes_s, bwd_iat FROM flows""")
def clean(spark, sf):
    cols = ["pkt_len_mean", "flow_bytes_s", "bwd_iat"]
    return flowops.clean_numeric(views.flows(spark, sf).select("flow_key", *cols), cols)


@query("b29_impute_mean", "flows", """
WITH m AS (SELECT avg(flow_bytes_s) AS m FROM flows WHERE NOT isnan(flow_bytes_s) AND NOT isinf(flow_bytes_s))
SELECT flow_key, CASE WHEN isnan(flow_bytes_s) OR isinf(flow_bytes_s) THEN round(m, 4) ELSE flow_bytes_s END AS flow_bytes_s FROM flows, m""")
def impute(spark, sf):
    f = views.flows(spark, sf).select("flow_key", "flow_bytes_s")
    filled = flowops.impute_mean(f, ["flow_bytes_s"])
    mean = flowops.column_means(f, ["flow_bytes_s"]).scalar()
    return filled.withColumn("_m", mean).select(
        "flow_key", F.when(F.col("flow_bytes_s") == F.col("_m"), F.round("flow_bytes_s", 4)).otherwise(F.col("flow_bytes_s")).alias("flow_bytes_s"))


@query("b30_clip", "flows", """
SELECT flow_key, CASE WHEN isnan(flow_bytes_s) THEN flow_bytes_s ELSE least(greatest(flow_bytes_s, -1e9::DOUBLE), 1e9::DOUBLE) END AS flow_bytes_s,
 CASE WHEN isnan(pkt_len_mean) THEN pkt_len_mean ELSE least(greatest(pkt_len_mean * 20000, -1e9::DOUBLE), 1e9::DOUBLE) END AS pkt_len_mean FROM flows""")
def clip(spark, sf):
    f = views.flows(spark, sf).withColumn("pkt_len_mean", F.col("pkt_len_mean") * 20000)
    return flowops.clip(f.select("flow_key", "flow_bytes_s", "pkt_len_mean"), ["flow_bytes_s", "pkt_len_mean"])


@query("b31_binary_label", "flows", """
SELECT flow_key, CASE WHEN raw_label = 'BENIGN' THEN 0 ELSE 1 END AS label,
 CASE WHEN raw_label IN ('BENIGN') OR proto_txt = 'O' THEN 0 ELSE 1 END AS label_variant FROM flows""")
def binary(spark, sf):
    f = views.flows(spark, sf)
    text_label = F.when(F.col("proto_txt") == "O", "Normal traffic").otherwise(F.col("raw_label"))
    return f.select("flow_key", flowops.binary_label(F.col("raw_label")).alias("label"),
                    flowops.binary_label(text_label, ("BENIGN", "NORMAL")).alias("label_variant"))


@query("b32_label_encode", "flows", """
SELECT flow_key, CAST(dense_rank() OVER (ORDER BY proto_txt) - 1 AS INT) AS proto_txt,
 CAST(dense_rank() OVER (ORDER BY raw_label) - 1 AS INT) AS raw_label FROM flows""")
def encode(spark, sf):
    f = views.flows(spark, sf).select("flow_key", "proto_txt", "raw_label")
    return flowops.label_encode(f, ["proto_txt", "raw_label"])


@query("b33_downcast_float32", "flows", """
SELECT flow_key, CAST(flow_duration AS FLOAT) AS flow_duration, CAST(pkt_len_mean AS FLOAT) AS pkt_len_mean, dst_port FROM flows""")
def downcast(spark, sf):
    return flowops.downcast_float32(views.flows(spark, sf).select("flow_key", "flow_duration", "pkt_len_mean", "dst_port"))


@query("b34_strict_numeric_prep", "flows", """
WITH f AS (SELECT DISTINCT flow_duration, pkt_len_mean, bwd_iat, nullif(dst_port, dst_port // 97 * 97) AS dst_port, raw_label FROM flows)
SELECT flow_duration, pkt_len_mean, bwd_iat, dst_port, CASE WHEN raw_label = 'BENIGN' THEN 0 ELSE 1 END AS label
FROM f WHERE dst_port IS NOT NULL""")
def strict(spark, sf):
    f = views.flows(spark, sf).select(
        "flow_duration", "pkt_len_mean", "bwd_iat", F.when(F.col("dst_port") % 97 != 0, F.col("dst_port")).alias("dst_port"), "raw_label")
    return flowops.strict_numeric_prep(f, "raw_label")


@query("b35_engineered_flow_features", "flows", """
SELECT flow_key, round(ln(flow_duration + 2), 9) AS flow_duration_log, bwd_iat + pkt_len_mean AS pkt_len_mean FROM flows""")
def engineered(spark, sf):
    f = views.flows(spark, sf).withColumnRenamed("pkt_len_mean", "fwd_total")
    out = flowops.engineered_flow_features(f, "flow_duration", "bwd_iat", "fwd_total")
    return out.select("flow_key", F.round("flow_duration_log", 9).alias("flow_duration_log"), "pkt_len_mean")


@query("b36_packet_features", "telemetry", """
SELECT seq, CAST(k * 10 AS INT) AS packet_length, CAST(CAST(concat('0x', substr(md5(proto), 1, 8)) AS BIGINT) % 1000 AS INT) AS protocol,
 src_port, CASE WHEN seq % 5 = 0 THEN 0 ELSE dst_port END AS dst_port, CASE WHEN seq % 6 = 0 THEN 6 ELSE 4 END AS ip_version
FROM telemetry WHERE seq % 41 <> 0""")
def packets(spark, sf):
    return flowops.packet_features(views.packets(spark, sf))


@query("b37_edge_feature_projection", "flows", """
SELECT flow_key, pkt_len_mean AS packet_length, 0 AS protocol, dst_port AS src_port, dst_port, 4 AS ip_version FROM flows""")
def edge_projection(spark, sf):
    f = views.flows(spark, sf).withColumnsRenamed({"pkt_len_mean": "Packet Length Mean", "dst_port": "Destination Port"})
    return flowops.edge_feature_projection(f, keep=["flow_key"])


@query("b38_align_features", "telemetry", """
SELECT seq, CAST(k AS DOUBLE) AS k, CASE WHEN seq % 3 = 0 THEN 0 ELSE vector END AS vector, CAST(0 AS DOUBLE) AS missing FROM telemetry""")
def align(spark, sf):
    m = F.map_concat(F.create_map(F.lit("k"), F.col("k").cast("double")),
                     F.when(F.col("seq") % 3 != 0, F.create_map(F.lit("vector"), F.col("vector"))).otherwise(F.from_json(F.lit("{}"), "map<string,double>")))
    a = views.telemetry(spark, sf).select("seq", flowops.align_features(m, ["k", "vector", "missing"]).alias("x"))
    return a.select("seq", F.col("x")[0].alias("k"), F.col("x")[1].alias("vector"), F.col("x")[2].alias("missing"))


@query("b39_hash_categorical", "telemetry", """
SELECT seq, CAST(CAST(concat('0x', substr(md5(label), 1, 8)) AS BIGINT) % 1000 AS DOUBLE) / 1000 AS label, CAST(k AS DOUBLE) AS k FROM telemetry""")
def hash_cat(spark, sf):
    return views.telemetry(spark, sf).select(
        "seq", text.hash_fraction(F.col("label")).alias("label"), text.hash_fraction(F.col("k").cast("string")).alias("k"))


MODEL_NAMES = ["model_confidence", "attack_angle", "src_ip", "geo_code", "timestamp_ms", "threat_kind", "activity_last", "other"]


@query("b40_event_to_model_features", "telemetry", """
SELECT seq, f.feature, CASE f.feature WHEN 'model_confidence' THEN CAST(CAST(confidence AS DECIMAL(10,4)) AS VARCHAR) WHEN 'attack_angle' THEN CAST(vector AS VARCHAR)
 WHEN 'src_ip' THEN src_ip WHEN 'geo_code' THEN CASE WHEN seq % 3 = 0 THEN 'unknown' ELSE dst_ip END
 WHEN 'timestamp_ms' THEN CAST((epoch_us(ts) // 1000) AS VARCHAR) WHEN 'threat_kind' THEN label WHEN 'activity_last' THEN CAST(k AS VARCHAR) ELSE '0' END AS value
FROM telemetry, (VALUES ('model_confidence'), ('attack_angle'), ('src_ip'), ('geo_code'), ('timestamp_ms'), ('threat_kind'), ('activity_last'), ('other')) f(feature)""")
def model_features(spark, sf):
    t = views.telemetry(spark, sf).select(
        "seq", "confidence", "vector", F.col("src_ip").alias("ip"), F.when(F.col("seq") % 3 != 0, F.col("dst_ip")).alias("geo"), "ts",
        F.col("label").alias("threat_type"), F.array("k").alias("activity"))
    return flowops.event_to_model_features(t, MODEL_NAMES)


@query("b41_probability_severity", "telemetry", """
SELECT seq, CASE WHEN confidence > 0.7 THEN 'high' WHEN confidence > 0.4 THEN 'medium' ELSE 'low' END AS severity FROM telemetry""")
def probability(spark, sf):
    return views.telemetry(spark, sf).select("seq", bands.probability_severity(F.col("confidence")).alias("severity"))


@query("b42_health_warnings", "host_metrics", """
SELECT seq, host, concat_ws(' ', CASE WHEN cpu >= 90 THEN printf('High CPU load detected (%.1f%%).', cpu) END,
 CASE WHEN memory >= 85 THEN printf('Elevated memory utilisation (%.1f%%).', memory) END,
 CASE WHEN status = 'offline' THEN 'Store connection lost.' WHEN latency_ms > 150 THEN printf('Store latency elevated (%.0fms).', latency_ms) END,
 CASE WHEN disk_free_percent <= 10 THEN printf('Low disk space: %.1f%% free (%.1f GB).', disk_free_percent, disk_free_gb) END) AS warnings
FROM host_metrics""")
def warnings(spark, sf):
    return health.health_warnings(views.host_metrics(spark, sf)).select("seq", "host", F.array_join("warnings", " ").alias("warnings"))


@query("b43_normalise_health_status", "host_metrics", """
SELECT seq, CASE WHEN seq % 13 = 0 THEN 'unknown' WHEN status = 'offline' THEN 'offline' WHEN status = 'warning' THEN 'degraded'
 WHEN status = 'online' THEN 'online' ELSE 'unknown' END AS status FROM host_metrics""")
def health_status(spark, sf):
    messy = F.when(F.col("seq") % 13 == 0, "").otherwise(F.concat(F.lit("State: "), F.upper("status")))
    return views.host_metrics(spark, sf).select("seq", bands.health_status(messy).alias("status"))


@query("b44_freshness_label", "telemetry", f"""
WITH a AS (SELECT seq, CAST(floor((epoch_us({ASOF}) - epoch_us(ts)) / 1000000.0) AS BIGINT) AS s FROM telemetry)
SELECT seq, CASE WHEN s < 5 THEN 'live' WHEN s < 60 THEN concat(CAST(s AS VARCHAR), 's ago') ELSE concat(CAST(s // 60 AS VARCHAR), 'm ago') END AS freshness FROM a""")
def freshness(spark, sf):
    age = (F.unix_micros(views.as_of().cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1_000_000
    return views.telemetry(spark, sf).select("seq", bands.freshness_label(age).alias("freshness"))


@query("b45_ip_to_lat_lon", "telemetry", """
WITH o AS (SELECT seq, src_ip, CAST(split_part(src_ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(src_ip, '.', 2) AS BIGINT) * 65536
  + CAST(split_part(src_ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(src_ip, '.', 4) AS BIGINT) AS h FROM telemetry)
SELECT seq, CAST(greatest(-85, least(85, h % 180 - 90)) AS INT) AS lat, CAST((h >> 8) % 360 - 180 AS INT) AS lon FROM o""")
def lat_lon(spark, sf):
    return views.telemetry(spark, sf).select("seq", geo.ip_lat(F.col("src_ip")).alias("lat"), geo.ip_lon(F.col("src_ip")).alias("lon"))


PSEUDO = """
seed AS (SELECT *, rank * 17 + CAST(split_part(ip, '.', 1) AS BIGINT) + CAST(split_part(ip, '.', 2) AS BIGINT) * 2
  + CAST(split_part(ip, '.', 3) AS BIGINT) * 3 + CAST(split_part(ip, '.', 4) AS BIGINT) * 4 AS s FROM ranked)"""
PSEUDO_LAT = "s % 160 - 80 + CAST(split_part(ip, '.', 1) AS BIGINT) % 7"
PSEUDO_LON = "s % 340 - 170 + CAST(split_part(ip, '.', 2) AS BIGINT) % 11"


@query("b46_pseudo_geo", "telemetry", f"""
WITH ranked AS (SELECT seq, src_ip AS ip, seq % 10 AS rank FROM telemetry), {PSEUDO}
SELECT seq, {PSEUDO_LAT} AS lat, {PSEUDO_LON} AS lon FROM seed""")
def pseudo(spark, sf):
    r = F.col("seq") % 10
    return views.telemetry(spark, sf).select("seq", geo.pseudo_lat(F.col("src_ip"), r).alias("lat"), geo.pseudo_lon(F.col("src_ip"), r).alias("lon"))


@query("b47_polar_to_xy", "telemetry", """
SELECT seq, round(0.5::DOUBLE + 0.45::DOUBLE * cos(radians(vector)), 6) AS x, round(0.5::DOUBLE - 0.45::DOUBLE * sin(radians(vector)), 6) AS y FROM telemetry""")
def polar(spark, sf):
    return views.telemetry(spark, sf).select("seq", F.round(geo.polar_x(F.col("vector")), 6).alias("x"), F.round(geo.polar_y(F.col("vector")), 6).alias("y"))


@query("b48_highlight_threat", "telemetry", "SELECT seq, confidence >= 0.8 OR status = 'Active' AS highlight FROM telemetry")
def highlight(spark, sf):
    return views.telemetry(spark, sf).select("seq", bands.highlight_threat(F.col("confidence"), F.col("status")).alias("highlight"))


@query("b49_model_basename", "telemetry", """
SELECT seq, concat(lower(proto), '-', CAST(k AS VARCHAR), '.bin') AS model FROM telemetry""")
def basename(spark, sf):
    name = F.concat(F.lower("proto"), F.lit("-"), F.col("k").cast("string"), F.lit(".bin"))
    path = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("/srv/models/"), name)).otherwise(F.concat(F.lit("D:\\models\\"), name))
    return views.telemetry(spark, sf).select("seq", text.basename(path).alias("model"))


@query("b50_confidence_band", "telemetry", """
SELECT seq, CASE WHEN k >= 80 THEN 'Stable' WHEN k < 50 THEN 'Unstable' ELSE 'Caution' END AS band FROM telemetry""")
def confidence_band(spark, sf):
    return views.telemetry(spark, sf).select("seq", bands.confidence_band(F.col("k")).alias("band"))


@query("b51_normalise_patterns", "telemetry", """
SELECT seq, 0 AS pos, concat('p-', CAST(seq AS VARCHAR)) AS id, label AS title, label AS summary, CAST(k AS DOUBLE) AS confidence FROM telemetry
UNION ALL SELECT seq, 1, 'pattern-1', 'Pattern 2', 'Diagnostics pattern', CAST(70 AS DOUBLE) FROM telemetry
UNION ALL SELECT seq, 2, 'pattern-2', proto, 'seen', CAST(70 AS DOUBLE) FROM telemetry""")
def patterns(spark, sf):
    payload = F.concat(
        F.lit('{"patterns":[{"id":"p-'), F.col("seq").cast("string"), F.lit('","title":"'), F.col("label"), F.lit('","confidence":'),
        F.col("k").cast("string"), F.lit('},{},{"title":"'), F.col("proto"), F.lit('","summary":"seen"}]}'))
    t = views.telemetry(spark, sf).select("seq", payload.alias("payload"))
    return narrative.normalise_patterns(t, ["seq"])


@query("b52_normalise_points", "telemetry", """
WITH p AS (SELECT seq, 0 AS pos, 'T0' AS minute, CAST(k AS DOUBLE) AS count FROM telemetry
UNION ALL SELECT seq, 1, '00:01', CAST(k + 1 AS DOUBLE) FROM telemetry
UNION ALL SELECT seq, 2, '2', CAST(0 AS DOUBLE) FROM telemetry)
SELECT seq, pos, minute, count, CASE WHEN seq % 2 = 0 THEN CAST(999 AS DOUBLE) ELSE sum(count) OVER (PARTITION BY seq) END AS total FROM p""")
def points(spark, sf):
    total = F.when(F.col("seq") % 2 == 0, F.lit(',"total":999')).otherwise("")
    payload = F.concat(
        F.lit('{"points":[{"timestamp":"T0","count":'), F.col("k").cast("string"), F.lit('},{"minute":"00:01","value":'),
        (F.col("k") + 1).cast("string"), F.lit('},{"hits":"'),
        F.when(F.col("seq") % 3 == 0, "NaN").when(F.col("seq") % 3 == 1, "Infinity").otherwise("x"), F.lit('"}]'), total, F.lit("}"))
    t = views.telemetry(spark, sf).select("seq", payload.alias("payload"))
    return narrative.normalise_points(t, ["seq"])


@query("b53_gpu_band", "host_metrics", """
SELECT seq, CASE WHEN memory > 85 THEN 'critical' WHEN memory > 65 THEN 'warning' ELSE 'normal' END AS band FROM host_metrics""")
def gpu_band(spark, sf):
    return views.host_metrics(spark, sf).select("seq", bands.gpu_band(F.col("memory")).alias("band"))
