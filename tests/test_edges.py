"""Validation, parsing and empty-input cases."""

import ipaddress
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from vigilframe.functions import bands, coerce, geo, logtext, text
from vigilframe.operators import flows, health, importance, ingest, logs, narrative, summary, threats
from vigilframe.sources import readers

AS_OF = "2024-01-01 01:00:00"
SCHEMA = "seq bigint, ts timestamp_ntz, src_ip string, dst_port int, proto string, label string, severity string, status string, is_attack boolean, confidence double"


def valid(ip):
    try:
        ipaddress.ip_address(ip)
        return True
    except ValueError:
        return False


def test_ip_validity_matches_the_standard_library(spark):
    rng = random.Random(11)
    cases = ["::", "::1", "1::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3", "fe80::1%eth0", "::ffff:10.0.0.1",
             "1:2:3:4:5:6:10.0.0.1", "10.0.0.01", "256.1.1.1", "1.2.3", "", "not-an-ip-address", "12345::", ":::", "1:2:3:4:5:6:7:8::", "::10.0.0.300", "g::"]
    for _ in range(3000):
        groups = [rng.choice(["", "0", "1", "ab", "ffff", "12345", "10.1.2.3"]) for _ in range(rng.randrange(1, 10))]
        cases.append(":".join(groups))
    df = spark.createDataFrame([(c,) for c in set(cases)], "ip string")
    for r in df.select("ip", coerce.is_valid_ip(F.col("ip")).alias("ok")).collect():
        assert r["ok"] == valid(r["ip"]), r["ip"]


@pytest.mark.parametrize("change,ok", [({}, True), ({"dst_port": 99999}, False), ({"src_port": -1}, False), ({"src_ip": "not-an-ip-address"}, False), ({"src_ip": None}, True)])
def test_ingest_validation(spark, change, ok):
    event = {"src_ip": "10.0.0.5", "dst_ip": "192.168.1.10", "src_port": 51515, "dst_port": 443, "proto": "TCP", "severity": "INFO", "message": "hello", **change}
    df = spark.createDataFrame([event], "src_ip string, dst_ip string, src_port int, dst_port int, proto string, severity string, message string")
    assert ingest.validate_events(df).first()["accepted"] is ok


def test_event_time_forms(spark):
    raw = {
        '{"timestamp": 1704067200}': "2024-01-01 00:00:00", '{"ts": 1704067200000}': "2024-01-01 00:00:00",
        '{"time": "2024-01-01T00:00:00.250Z"}': "2024-01-01 00:00:00.250000", '{"@timestamp": "2024-01-01T02:00:00+02:00"}': "2024-01-01 00:00:00",
        '{"timestamp": "soon", "ts": "2024-01-01 00:00:05"}': "2024-01-01 00:00:05", '{"timestamp": "soon"}': AS_OF, "{}": AS_OF,
        '{"timestamp": 1704067200000000000}': AS_OF, '{"timestamp": 1e300, "ts": 1704067200}': "2024-01-01 00:00:00", '{"time": -1e18}': AS_OF,
    }
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    got = ingest.scan_json_events(df).select("raw", coerce.event_time(F.col("event"), F.lit(AS_OF).cast("timestamp_ntz")).alias("ts"))
    assert {r["raw"]: str(r["ts"]) for r in got.collect()} == raw


def test_aliases_and_types(spark):
    df = spark.createDataFrame([('{"src_ip": 5, "source": {"ip": "1.2.3.4"}, "port": "x", "dest_port": 80.5, "destination": {"port": "90"}, "protocol": "tcp", "is_attack": false, "level": "Malicious"}',)], "raw string")
    e = F.col("event")
    r = ingest.scan_json_events(df).select(coerce.source_ip(e), coerce.destination_port(e), coerce.protocol(e), coerce.raw_is_attack(e)).first()
    assert tuple(r) == ("1.2.3.4", "90", "TCP", True)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_summary_and_texts(spark, empty):
    events = summary.with_attack(empty)
    one = summary.attack_summary(events, AS_OF, 5).first()
    assert one["total_events"] == 0 and one["attack_rate"] == 0.0 and one["top_ips"] == []
    assert [t["minute"] for t in one["timeline"]] == ["00:56", "00:57", "00:58", "00:59", "01:00"]
    doc = summary.attack_summary(events, AS_OF, 5)
    said = narrative.incident_narrative(doc, F.lit(AS_OF).cast("timestamp_ntz"), 5).first()[0]
    assert said == "01:00 UTC: nothing hostile in the past 5 minutes."
    assert narrative.cycle_summary_text(doc).first()[0] == "Quiet cycle: no hostile event."
    stats = threats.threat_stats(empty).first()
    assert tuple(stats) == (0, 0, 0, 0.0)


def test_window_edges(spark):
    rows = [(1, "2024-01-01 00:54:59"), (2, "2024-01-01 00:55:00"), (3, "2024-01-01 01:00:00"), (4, "2024-01-01 01:07:00")]
    df = spark.createDataFrame(rows, "seq int, t string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    assert [r["seq"] for r in threats.lookback(df, AS_OF, 5).orderBy("seq").collect()] == [2, 3, 4]
    assert [r["seq"] for r in threats.lookback(df, None, 5).orderBy("seq").collect()] == [4]
    with pytest.raises(ValueError):
        threats.lookback(df, AS_OF, 0)


def test_top_k_ties(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "a"), (5, "c")], "seq int, v string")
    assert [r["v"] for r in summary.top_k(df, "v").collect()] == ["a", "b", "c"]
    assert [r["v"] for r in summary.top_k(df.filter("seq < 4 or seq = 5"), "v", newest_first=True).collect()] == ["b", "c", "a"]
    assert [r["v"] for r in summary.top_k(df, "v", newest_first=False).collect()] == ["a", "b", "c"]


def test_log_lines(spark):
    lines = {
        "[2024-01-01 00:00:01] [ATTACK DETECTED] | Src IP: 1.2.3.4 | Src Port: 5 | Dst IP: 6.7.8.9 | Dst Port: 80": ("attack", "1.2.3.4", 80),
        "[2024-01-01 00:00:01] odd | src ip:  | SRC PORT: 5 | dst ip: | dst port: 81": ("normal", None, 81),
        "[2024/01/01 00:00:01] Attack wave | Src Port: 5 | Dst Port: 82": ("attack", None, 82),
        "garbage": ("normal", None, None),
        "": ("normal", None, None),
    }
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = logs.parse_lines(df, F.lit(AS_OF).cast("timestamp_ntz")).collect()
    assert {r["line"]: (r["category"], r["src_ip"], r["dst_port"]) for r in got} == lines
    assert {r["line"] for r in got if not r["parse_ok"]} == {"garbage", ""}


def test_written_line_reads_back(spark):
    df = spark.createDataFrame([("1.2.3.4", 5, 80)], "src_ip string, s int, d int")
    line = logtext.detection_line(F.lit(AS_OF).cast("timestamp_ntz"), F.lit(True), F.col("src_ip"), F.col("s"), F.col("d"))
    r = logs.parse_lines(df.select(line.alias("line")), F.lit(None).cast("timestamp_ntz")).first()
    assert r["category"] == "attack" and r["dst_port"] == 80 and r["src_ip"] is None and str(r["ts"]) == AS_OF


def test_spike_rules(spark):
    def states(counts):
        rows = [(f"2024-01-01 00:{i:02d}:00", c) for i, c in enumerate(counts)]
        df = spark.createDataFrame(rows, "t string, count bigint").withColumn("minute", F.col("t").cast("timestamp_ntz"))
        return [r["state"] for r in summary.spike_states(df).orderBy("minute").collect()]

    assert states([2, 2, 4]) == ["steady", "steady", "spike"]
    assert states([8, 8, 4]) == ["steady", "steady", "cooled"]
    assert states([1, 2]) == ["steady", "steady"]


def test_spikes_of_all_alerts(spark, small, monkeypatch):
    from vigilframe import plans
    from vigilframe.sources import views

    alerts = views.telemetry(spark, small).where("severity = 'ALERT'").where(F.col("ts") >= F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    rows = plans.QUERIES["e7_spike_or_cooldown"](spark, small)
    assert rows.count() == 60
    shown = alerts.where(F.col("ts") >= F.lit("2024-01-01 00:01:00").cast("timestamp_ntz")).count()
    assert rows.agg(F.sum("count")).first()[0] == shown > 0
    # Empty minutes: 10 alerts at 00:30, 20 at 00:45, other rows everywhere.
    few = spark.createDataFrame(
        [(i, f"2024-01-01 00:{m}:00", level) for i, (m, level) in enumerate(
            [("30", "ALERT")] * 10 + [("45", "ALERT")] * 20 + [(f"{m:02d}", "INFO") for m in range(60)])],
        "seq bigint, t string, severity string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    monkeypatch.setattr(views, "telemetry", lambda spark, sf: few)
    got = {str(r["minute"])[11:16]: (r["count"], r["state"]) for r in plans.QUERIES["e7_spike_or_cooldown"](spark, small).collect()}
    assert len(got) == 60 and got["00:29"] == (0, "steady") and got["00:30"] == (10, "spike") and got["00:31"] == (0, "cooled")
    assert got["00:45"] == (20, "spike") and got["01:00"] == (0, "cooled") and sum(c for c, _ in got.values()) == 30


def test_small_mappings(spark):
    df = spark.range(1)
    one = lambda c: df.select(c).first()[0]
    assert one(geo.ip_lat(F.lit("abc"))) is None and one(geo.ip_lat(F.lit(""))) is None
    assert one(bands.freshness_label(F.lit(59.9))) == "59s ago"
    assert one(bands.rescale_index(F.lit(0.0), F.lit(3))) == 25.5
    assert one(bands.threat_status(F.lit(" aCTIVE "))) == "Active"
    assert one(text.duration_hms(F.lit(3661))) == "01:01:01" and one(text.duration_hm(F.lit(3661))) == "1h 1m"
    assert one(text.basename(F.lit("D:\\m\\x.bin"))) == "x.bin"
    assert one(bands.health_status(F.lit("Degraded"))) == "degraded"


def test_source_fallback_and_capped_list(spark):
    a, b = spark.createDataFrame([], "v int"), spark.createDataFrame([(1,), (2,)], "v int")
    assert summary.source_fallback(a, b, b.limit(1)).count() == 2
    assert summary.source_fallback(a, a).count() == 0
    long = spark.range(20).select(F.col("id").cast("int").alias("v"))
    got = [r["v"] for r in narrative.append_capped(spark.createDataFrame([(99,)], "v int"), long, "v").collect()]
    assert got == [99, *range(11)]


def test_constant_importance(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "name string, score double")
    assert {r["normalized_score"] for r in importance.normalise_importance(df).collect()} == {0.0}
    with pytest.raises(ValueError):
        importance.top_feature_signals(df, 33)


def test_last_lines_per_file(spark, tmp_path):
    for name, count in (("detection_log_1.txt", 500), ("detection_log_2.txt", 3), ("other.txt", 9)):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" for i in range(count)))
    lines = readers.read_log_dir(spark, str(tmp_path))
    got = readers.last_lines(lines, 5).orderBy("file", F.col("from_end").desc()).collect()
    assert [r["line"] for r in got] == [f"detection_log_1.txt {i}" for i in range(495, 500)] + [f"detection_log_2.txt {i}" for i in range(3)]


def test_latest_log(spark, tmp_path):
    import os

    for age, name in enumerate(("detection_log_b.txt", "detection_log_a.txt")):
        path = tmp_path / name
        path.write_text(name + "\n")
        os.utime(path, (1_700_000_000 + age, 1_700_000_000 + age))
    assert [r["line"] for r in readers.latest_log_only(spark, str(tmp_path)).collect()] == ["detection_log_a.txt"]


def test_csv_files_are_united_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,label\n1,up\n2,down\n")
    (tmp_path / "b.csv").write_text("label,x,extra\nup,7,q\nup,n/a,r\n")
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "broken.csv.gz").write_bytes(b"no gzip at all")
    typed = readers.scan_flow_csvs(spark, str(tmp_path), "x int, label string")
    rows = sorted((r["x"] or 0, r["label"], r["extra"], r["_corrupt_record"]) for r in typed.collect())
    assert rows == [(0, "up", "r", "up,n/a,r"), (1, "up", None, None), (2, "down", None, None), (7, "up", "q", None)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "big.csv").write_text("x\n" + "1\n" * 20000 + "7.5\n")
    assert readers.scan_flow_csvs(spark, str(tmp_path / "d")).agg(F.max("x")).first()[0] == 7.5
    assert [r["file_id"].rsplit("/", 1)[1] for r in readers.skipped_csvs(spark, str(tmp_path), "*.csv*").collect()] == ["broken.csv.gz"]
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        readers.scan_flow_csvs(spark, str(tmp_path / "none"), "x int")


def test_ids_tell_events_apart(spark):
    rows = [("a", None, 1, None), (None, "a", 1, None), ("a", None, 2, None), ("a", None, 1, None), ("a", None, 1, "given")]
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, t int, id string").withColumn(
        "ts", F.timestamp_seconds("t").cast("timestamp_ntz"))
    ids = [r["id"] for r in ingest.default_event_fields(df, F.lit(AS_OF).cast("timestamp_ntz"), content=("src_ip", "dst_ip")).collect()]
    assert ids[0] == ids[3] and ids[4] == "given" and len(set(ids)) == 4


def test_only_the_named_pulse_goes(spark):
    df = spark.createDataFrame([(" Sensor auto-pulse ok",), ("worm auto-pulse",), (None,)], "message string")
    assert [r[0] for r in ingest.drop_heartbeats(df, producer="sensor").collect()] == ["worm auto-pulse", None]


def test_warning_numbers_are_rounded_as_in_sql(spark):
    """90.35 lies just below the tie, 90.25 on it; the texts are those of the checking database."""
    values = [90.35, 90.25, 90.15, 90.45, 99.95, 452.5, 451.5]
    rows = [(n, f"h{n}", v, v, v, (v - 90) * 2, v + 1000, "online") for n, v in enumerate(values)]
    df = spark.createDataFrame(rows, "seq long, host string, cpu double, memory double, latency_ms double, disk_free_percent double, disk_free_gb double, status string")
    got = health.health_warnings(df).select("seq", "host", F.array_join("warnings", " ").alias("warnings"))
    host_metrics = df.toPandas()  # noqa: F841
    from vigilframe import plans
    con = duckdb.connect()
    con.register("host_metrics", host_metrics)
    body = plans.ORACLES["b42_health_warnings"].rsplit("FROM events\n)", 1)[1]
    want = con.execute(body).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_rows_of_few_labels_stay_in_their_partitions(spark):
    df = spark.range(0, 3_000_000, 1, 6).selectExpr("id", "IF(id % 7 = 0, NULL, CAST(id % 2 AS STRING)) AS t")
    got = flows.label_encode(df, ["t"]).withColumn("p", F.spark_partition_id())
    rows = {r["p"]: (r["n"], r["odd"], r["none"]) for r in got.groupBy("p").agg(
        F.count("*").alias("n"), F.sum("t").alias("odd"), F.count_if(F.col("t").isNull()).alias("none")).collect()}
    assert max(n for n, _, _ in rows.values()) == 500_000
    assert sum(n for n, _, _ in rows.values()) == 3_000_000
    assert sum(odd for _, odd, _ in rows.values()) == sum(1 for n in range(1, 3_000_000, 2) if n % 7)
    assert sum(none for _, _, none in rows.values()) == len(range(0, 3_000_000, 7))


def test_preparation_reads_its_rows_once(spark):
    """Filled columns have no gaps left, so no means are looked for; values and types are as with them."""
    rows = spark.createDataFrame(
        [("a", float("nan"), 7, "BENIGN"), ("b", float("inf"), None, "Bot"), ("c", 4e9, 1, None), ("c", 4e9, 1, None), ("d", -0.5, 2, "x")], "k string, x double, n int, l string")
    got = flows.preprocess(rows, "l", ["x", "n"])
    assert sorted(got.collect()) == [("a", 0.0, 7.0, "BENIGN", 0), ("b", 0.0, 0.0, "Bot", 1), ("c", 1e9, 1.0, None, 1), ("d", -0.5, 2.0, "x", 1)]
    assert dict(got.dtypes)["n"] == "double" and "subquery" not in got._jdf.queryExecution().optimizedPlan().toString()
