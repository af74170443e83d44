"""The input views of FIXTURES.md, written once for both SQL dialects.

Each template yields the same rows in Spark and in the checking database; they differ
only in the timestamp, JSON and integer-division spellings held in the dialect maps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The 30 source days are compressed 720-fold into this hour.
EPOCH_MICROS = 1704067200000000
AS_OF = "2024-01-01 01:00:00"

SPARK = {
    "ts": f"CAST(timestamp_micros({EPOCH_MICROS} + (unix_micros(CAST(ts AS TIMESTAMP)) - {EPOCH_MICROS}) div 720) AS TIMESTAMP_NTZ)",
    "k": "CAST(get_json_object(props, '$.k') AS INT)",
    "div": "div",
    "text_of": "date_format({0}, 'yyyy-MM-dd HH:mm:ss')",
}
DUCK = {
    "ts": f"make_timestamp({EPOCH_MICROS} + (epoch_us(ts) - {EPOCH_MICROS}) // 720)",
    "k": "CAST(json_extract_string(props, '$.k') AS INT)",
    "div": "//",
    "text_of": "strftime({0}, '%Y-%m-%d %H:%M:%S')",
}

_SRC_IP = (
    "concat('10.', CAST(user_id % 3 AS STRING), '.', CAST(user_id {div} 256 % 256 AS STRING), "
    "'.', CAST(user_id % 256 AS STRING))"
)

TELEMETRY = """
SELECT event_id AS seq, {ts} AS ts, """ + _SRC_IP + """ AS src_ip,
  concat('192.168.0.', CAST(event_id % 5 + 1 AS STRING)) AS dst_ip,
  CAST(1024 + (event_id * 7919) % 64512 AS INT) AS src_port,
  CASE {k} % 8 WHEN 0 THEN 22 WHEN 1 THEN 80 WHEN 2 THEN 443 WHEN 3 THEN 3389
               WHEN 4 THEN 8080 WHEN 5 THEN 445 WHEN 6 THEN 53 ELSE 4444 END AS dst_port,
  CASE event_id % 3 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' ELSE 'HTTP' END AS proto,
  CASE event_type WHEN 'error' THEN 'ALERT' WHEN 'purchase' THEN 'WARNING'
                  WHEN 'signup' THEN 'HIGH' WHEN 'click' THEN 'CRITICAL' ELSE 'INFO' END AS severity,
  CASE event_type WHEN 'error' THEN 'Port Scan attack' WHEN 'signup' THEN 'malicious login'
                  ELSE 'benign' END AS label,
  {k} AS k,
  (event_type = 'error' AND value > 20) AS is_attack,
  round(least(value / CAST(500 AS DOUBLE), CAST(1 AS DOUBLE)), 4) AS confidence,
  CAST((event_id * 37) % 3600 AS DOUBLE) / CAST(10 AS DOUBLE) AS vector,
  CASE event_type WHEN 'error' THEN 'Active' WHEN 'purchase' THEN 'Blocked'
                  ELSE 'Monitoring' END AS status
FROM events
"""

_STATE = "CASE WHEN event_type = 'error' THEN '[ATTACK DETECTED]' ELSE 'Normal Traffic' END"
_PORT = "CAST(1024 + (event_id * 7919) % 64512 AS STRING)"
LOG_LINES = f"""
SELECT event_id AS seq, CASE
  WHEN event_id % 97 = 0 THEN 'heartbeat ok'
  WHEN event_id % 10 = 0 THEN concat('[', {{tstext}}, '] ', {_STATE}, ' | Src Port: ',
       {_PORT}, ' | Dst Port: ', CAST(user_id AS STRING))
  ELSE concat('[', {{tstext}}, '] ', {_STATE}, ' | Src IP: ', {_SRC_IP},
       ' | Src Port: ', {_PORT},
       ' | Dst IP: 192.168.0.', CAST(event_id % 5 + 1 AS STRING), ' | Dst Port: 443') END AS line
FROM events
"""

FLOWS = """
SELECT l_orderkey * 10 + l_linenumber AS row_id, l_shipdate AS day,
  l_quantity AS flow_duration, l_extendedprice AS pkt_len_mean, l_tax AS bwd_iat,
  CASE WHEN l_discount = 0 THEN CAST('Infinity' AS DOUBLE)
       WHEN l_tax = 0 THEN CAST('NaN' AS DOUBLE)
       ELSE l_extendedprice * l_discount END AS flow_bytes_s,
  CAST(l_partkey % 65536 AS INT) AS dst_port, l_linestatus AS proto_txt,
  CASE WHEN (l_orderkey * 31 + l_linenumber) % 20 = 0 THEN 'Bot'
       WHEN l_quantity > 30 AND l_discount >= 0.05 THEN 'DDoS'
       WHEN l_extendedprice > 60000 THEN 'PortScan' ELSE 'BENIGN' END AS raw_label,
  concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING),
       CAST(l_suppkey AS STRING), CAST(CAST(l_quantity AS INT) AS STRING)) AS flow_key
FROM lineitem
"""

HOST_METRICS = """
SELECT event_id AS seq, {ts} AS ts, concat('node-', CAST(user_id % 8 AS STRING)) AS host,
  least(value / CAST(5 AS DOUBLE), CAST(100 AS DOUBLE)) AS cpu,
  CAST(({k} + 10) % 101 AS DOUBLE) AS memory,
  CAST((event_id * 13) % 200 AS DOUBLE) AS latency_ms,
  CAST({k} % 100 AS DOUBLE) AS disk_free_percent,
  CAST({k} % 100 AS DOUBLE) * CAST(5 AS DOUBLE) AS disk_free_gb,
  event_id % 90 AS hits, event_id % 10 AS misses,
  CASE WHEN event_id % 50 = 0 THEN 'offline' WHEN event_id % 17 = 0 THEN 'warning'
       WHEN event_id % 31 = 0 THEN 'maintenance' ELSE 'online' END AS status
FROM events
"""

# Raw JSON text of the events: field aliases rotate by seq, some strings are not JSON.
RAW_EVENTS = """
SELECT seq, CASE
  WHEN seq % 101 = 0 THEN concat('not json ', CAST(seq AS STRING))
  WHEN seq % 103 = 0 THEN '[1,2]'
  WHEN seq % 4 = 0 THEN concat('{{"timestamp":"', {tstext2}, '","src_ip":"', src_ip, '","dst_port":',
       CAST(dst_port AS STRING), ',"proto":"', lower(proto), '","label":"', label, '","severity":"', severity, '","bytes_in":', CAST(k AS STRING), '}}')
  WHEN seq % 4 = 1 THEN concat('{{"ts":', CAST({epoch} AS STRING), ',"source_ip":"', src_ip, '","destination_port":"',
       CAST(dst_port AS STRING), '","protocol":"', proto, '","category":"', label, '","is_attack":', CASE WHEN is_attack THEN 'true' ELSE 'false' END, '}}')
  WHEN seq % 4 = 2 THEN concat('{{"timestamp":"bad","time":', CAST({epoch} * 1000 AS STRING), ',"src_ip":"","source":{{"ip":"', src_ip, '"}},"destination":{{"port":',
       CAST(dst_port AS STRING), '}},"protocol_name":"', proto, '","status":"', status, '","severity":null}}')
  ELSE concat('{{"@timestamp":"', {tstext}, '","attacker_ip":"', src_ip, '","port":"x","dest_port":', CAST(dst_port AS STRING),
       ',"level":"', lower(severity), '"}}') END AS raw
FROM telemetry
"""

# Events as producers post them: some broken, some with fields missing.
INBOUND = """
SELECT seq, CASE WHEN seq % 6 = 0 THEN NULL ELSE ts END AS ts,
  CASE WHEN seq % 83 = 0 THEN 'not-an-ip-address' WHEN seq % 59 = 0 THEN NULL
       WHEN seq % 61 = 0 THEN concat('fe80::', CAST(seq % 9999 AS STRING)) ELSE src_ip END AS src_ip,
  CASE WHEN seq % 107 = 0 THEN '192.168.0.300' ELSE dst_ip END AS dst_ip,
  CASE WHEN seq % 89 = 0 THEN -1 ELSE src_port END AS src_port,
  CASE WHEN seq % 97 = 0 THEN 99999 ELSE dst_port END AS dst_port,
  CASE WHEN seq % 79 = 0 THEN repeat(proto, 20) ELSE proto END AS proto, severity,
  CASE WHEN seq % 73 = 0 THEN repeat('x', 2049)
       WHEN seq % 71 = 0 THEN '  Sensor auto-pulse ok' ELSE label END AS message
FROM telemetry
"""

# Model importance per traffic kind, and the lines of a hand-written importance file.
IMPORTANCE = """
SELECT concat(lower(proto), '_', CAST(dst_port AS STRING)) AS name,
  round(avg(k) * (dst_port % 7 + 1) / CAST(800 AS DOUBLE) - CASE WHEN dst_port = 53 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, 4) AS score
FROM telemetry
GROUP BY proto, dst_port
"""
IMPORTANCE_LINES = """
SELECT seq, CASE seq % 10 WHEN 0 THEN '' WHEN 1 THEN 'name,importance' WHEN 2 THEN 'lonely'
  WHEN 3 THEN concat(' f', CAST(k AS STRING), ' , ', CAST(confidence AS STRING))
  WHEN 4 THEN concat('f', CAST(seq AS STRING), ',', CAST(confidence AS STRING), ',extra')
  ELSE concat('f', CAST(seq AS STRING), ',', CAST(confidence AS STRING)) END AS line
FROM telemetry
"""
PACKETS = """
SELECT seq, ts, CASE WHEN seq % 41 <> 0 THEN k * 10 END AS length, proto AS highest_layer, src_port,
  CASE WHEN seq % 5 = 0 THEN NULL ELSE dst_port END AS dst_port,
  CASE WHEN seq % 6 = 0 THEN concat('fe80::', CAST(seq % 9999 AS STRING)) ELSE src_ip END AS src_ip
FROM telemetry
"""

_TEXT = {"spark": SPARK, "duck": DUCK}
VIEWS = {
    "telemetry": (TELEMETRY, ()),
    "log_lines": (LOG_LINES, ()),
    "flows": (FLOWS, ()),
    "host_metrics": (HOST_METRICS, ()),
    "raw_events": (RAW_EVENTS, ("telemetry",)),
    "inbound": (INBOUND, ("telemetry",)),
    "importance": (IMPORTANCE, ("telemetry",)),
    "importance_lines": (IMPORTANCE_LINES, ("telemetry",)),
    "packets": (PACKETS, ("telemetry",)),
}


def view_sql(name: str, dialect: str) -> str:
    """The SELECT behind a view in the ``spark`` or ``duck`` dialect."""
    words = _TEXT[dialect]
    iso = {"spark": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")",
           "duck": "strftime(ts, '%Y-%m-%dT%H:%M:%S')"}[dialect]
    epoch = {"spark": "unix_seconds(CAST(ts AS TIMESTAMP))",
             "duck": "CAST(floor(epoch(ts)) AS BIGINT)"}[dialect]
    stamp = words["ts"] if name == "log_lines" else "ts"
    return VIEWS[name][0].format(
        ts=words["ts"], k=words["k"], div=words["div"],
        tstext=words["text_of"].format(stamp), tstext2=f"concat({iso}, 'Z')", epoch=epoch,
    )


def oracle_with(names: str, body: str) -> str:
    """Prefix a checking query with the views it reads."""
    wanted: list[str] = []
    for name in names.split():
        for dep in (*VIEWS[name][1], name):
            if dep not in wanted:
                wanted.append(dep)
    ctes = ",\n".join(f"{n} AS ({view_sql(n, 'duck')})" for n in wanted)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[14:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    for alias, frame in tables.items():
        sql = sql.replace(f"FROM {alias}\n", f"FROM {{{alias}}}\n")
    return spark.sql(sql, **tables)


def telemetry_from(events: DataFrame) -> DataFrame:
    return _over(events.sparkSession, view_sql("telemetry", "spark"), events=events)


def log_lines_from(events: DataFrame) -> DataFrame:
    return _over(events.sparkSession, view_sql("log_lines", "spark"), events=events)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_from(table(spark, sf_dir, "events"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_lines_from(table(spark, sf_dir, "events"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, view_sql("flows", "spark"), lineitem=table(spark, sf_dir, "lineitem"))


def host_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, view_sql("host_metrics", "spark"), events=table(spark, sf_dir, "events"))


def raw_events_from(telemetry_df: DataFrame) -> DataFrame:
    # The SQL formatter of spark.sql would read the JSON braces as fields: use selectExpr.
    body = view_sql("raw_events", "spark").strip()
    case = body[len("SELECT seq, "):body.rindex(" AS raw")].strip()
    # The generator keeps each of the many fields read from the text from building it anew.
    return telemetry_df.selectExpr("seq", f"explode(array({case})) AS raw")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events_from(telemetry(spark, sf_dir))


def inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, view_sql("inbound", "spark"), telemetry=telemetry(spark, sf_dir))


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, view_sql("importance", "spark"), telemetry=telemetry(spark, sf_dir))


def importance_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, view_sql("importance_lines", "spark"), telemetry=telemetry(spark, sf_dir))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, view_sql("packets", "spark"), telemetry=telemetry(spark, sf_dir))


def as_of(value: str = AS_OF):
    return F.lit(value).cast("timestamp_ntz")
