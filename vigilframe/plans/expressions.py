"""One query per family of scalar functions the reference operators lean on."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.functions import coerce, logtext, text
from vigilframe.plans.registry import query
from vigilframe.plans.scalar import DUCK_FULL_SQL
from vigilframe.sources import views


@query("h1_string_functions", "telemetry", """
SELECT seq, upper(label) AS up, lower(proto) AS low, trim(concat('  ', label, ' ')) AS trimmed, contains(lower(label), 'attack') AS has_attack,
 starts_with(label, 'Port') AS starts, split_part(src_ip, '.', 4) AS last_octet, substr(label, 1, 4) AS head, printf('%s/%05d', proto, dst_port) AS tag FROM telemetry""")
def strings(spark, sf):
    return views.telemetry(spark, sf).select(
        "seq", F.upper("label").alias("up"), F.lower("proto").alias("low"), F.trim(F.concat(F.lit("  "), "label", F.lit(" "))).alias("trimmed"),
        F.lower("label").contains("attack").alias("has_attack"), F.col("label").startswith("Port").alias("starts"),
        F.substring_index("src_ip", ".", -1).alias("last_octet"), F.substring("label", 1, 4).alias("head"),
        F.format_string("%s/%05d", "proto", "dst_port").alias("tag"))


@query("h2_regex_functions", "log_lines", f"""
SELECT seq, regexp_matches(line, {DUCK_FULL_SQL}, 'i') AS full_line, regexp_extract(line, 'src port:\\s*(\\d+)', 1, 'i') AS port FROM log_lines""")
def regexes(spark, sf):
    line = F.col("line")
    return views.log_lines(spark, sf).select("seq", logtext.matches_full(line).alias("full_line"), F.regexp_extract(line, r"(?i)src port:\s*(\d+)", 1).alias("port"))


@query("h3_date_functions", "telemetry", """
SELECT seq, strftime(ts, '%H:%M') AS hhmm, date_trunc('minute', ts) AS minute, ts - INTERVAL 5 MINUTE AS earlier,
 make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000) AS from_seconds, make_timestamp((epoch_us(ts) // 1000) * 1000) AS from_millis,
 date_trunc('second', ts) AS parsed_back, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM telemetry""")
def dates(spark, sf):
    z = F.col("ts").cast("timestamp")
    ntz = lambda c: c.cast("timestamp_ntz")
    return views.telemetry(spark, sf).select(
        "seq", F.date_format("ts", "HH:mm").alias("hhmm"), ntz(F.date_trunc("minute", "ts")).alias("minute"),
        (F.col("ts") - F.expr("interval 5 minutes")).alias("earlier"), ntz(F.timestamp_seconds(F.unix_seconds(z))).alias("from_seconds"),
        ntz(F.timestamp_millis(F.unix_millis(z))).alias("from_millis"),
        coerce.parse_time(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("parsed_back"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("h4_math_functions", "telemetry", """
SELECT seq, round(tanh(confidence), 9) AS tanh, round(ln(1 + k), 9) AS log1p, round(sqrt(k), 9) AS sqrt, round(vector, 0) AS rounded,
 least(greatest(k, 10), 90) AS clipped, abs(k - 50) AS away, CAST(((k - 50) % 7 + 7) % 7 AS INT) AS modulo, round(sin(radians(vector)), 9) + 0 AS sine, round(cos(radians(vector)), 9) + 0 AS cosine FROM telemetry""")
def maths(spark, sf):
    k = F.col("k")
    return views.telemetry(spark, sf).select(
        "seq", F.round(F.tanh("confidence"), 9).alias("tanh"), F.round(F.log1p(k), 9).alias("log1p"), F.round(F.sqrt(k), 9).alias("sqrt"),
        F.round("vector", 0).alias("rounded"), F.least(F.greatest(k, F.lit(10)), F.lit(90)).alias("clipped"), F.abs(k - 50).alias("away"),
        F.pmod(k - 50, F.lit(7)).alias("modulo"), F.round(F.sin(F.radians("vector")), 9).alias("sine"), F.round(F.cos(F.radians("vector")), 9).alias("cosine"))


@query("h5_hash_bucket", "telemetry", """
SELECT seq, CAST(concat('0x', substr(md5(src_ip), 1, 8)) AS BIGINT) % 1000 AS bucket FROM telemetry""")
def hashes(spark, sf):
    return views.telemetry(spark, sf).select("seq", text.hash_bucket(F.col("src_ip")).alias("bucket"))


@query("h6_array_functions", "telemetry", """
WITH a AS (SELECT seq, [k, k + 1, k + 2, CAST(seq % 10 AS INT)] AS l FROM telemetry)
SELECT seq, array_to_string(list_slice(l, -2, -1), ',') AS last_two, array_to_string(list_append(l, 7), ',') AS appended, array_to_string(list_reverse(l), ',') AS reversed,
 array_to_string(list_transform(l, lambda x: x * 2), ',') AS doubled, array_to_string(list_filter(l, lambda x: x > 50), ',') AS large, CAST(list_sum(l) AS INT) AS total FROM a""")
def arrays(spark, sf):
    a = views.telemetry(spark, sf).select("seq", F.array("k", F.col("k") + 1, F.col("k") + 2, (F.col("seq") % 10).cast("int")).alias("l"))
    show = lambda c, n: F.array_join(c.cast("array<string>"), ",").alias(n)
    return a.select(
        "seq", show(F.slice("l", -2, 2), "last_two"), show(F.array_append("l", F.lit(7)), "appended"), show(F.reverse("l"), "reversed"),
        show(F.transform("l", lambda x: x * 2), "doubled"), show(F.filter("l", lambda x: x > 50), "large"),
        F.aggregate("l", F.lit(0), lambda s, x: s + x).alias("total"))


@query("h7_map_functions", "telemetry", """
SELECT seq, CASE WHEN k >= dst_port % 100 THEN 'k' ELSE 'port' END AS largest, k AS given, -1 AS missing FROM telemetry""")
def maps(spark, sf):
    m = F.create_map(F.lit("k"), F.col("k"), F.lit("port"), F.col("dst_port") % 100)
    ordered = F.array_sort(F.map_entries(m), lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).otherwise(0))
    return views.telemetry(spark, sf).select(
        "seq", ordered[0]["key"].alias("largest"), F.element_at(m, "k").alias("given"), F.coalesce(F.try_element_at(m, F.lit("none")), F.lit(-1)).alias("missing"))


@query("h8_json_functions", "telemetry", """
SELECT seq, concat('{"src_ip":"', src_ip, '","k":', CAST(k AS VARCHAR), '}') AS encoded, k AS decoded, src_ip AS nested FROM telemetry""")
def jsons(spark, sf):
    encoded = F.to_json(F.struct("src_ip", "k"))
    return views.telemetry(spark, sf).select(
        "seq", encoded.alias("encoded"), F.from_json(encoded, "src_ip string, k int")["k"].alias("decoded"),
        F.get_json_object(F.to_json(F.struct(F.struct("src_ip").alias("source"))), "$.source.src_ip").alias("nested"))


@query("h9_null_handling", "inbound", """
SELECT seq, coalesce(nullif(trim(src_ip), ''), 'none') AS first_text, coalesce(src_ip, dst_ip) AS fallback FROM inbound""")
def nulls(spark, sf):
    return views.inbound(spark, sf).select(
        "seq", F.coalesce(coerce.first_text(F.trim("src_ip")), F.lit("none")).alias("first_text"), F.coalesce("src_ip", "dst_ip").alias("fallback"))


@query("h10_duration_format", "telemetry", """
SELECT seq, printf('%02d:%02d:%02d', seq // 3600, seq // 60 % 60, seq % 60) AS hms, printf('%dh %dm', seq // 3600, seq // 60 % 60) AS hm FROM telemetry""")
def durations(spark, sf):
    return views.telemetry(spark, sf).select("seq", text.duration_hms(F.col("seq")).alias("hms"), text.duration_hm(F.col("seq")).alias("hm"))
