"""Segmented operators against plain sequential replays, with one very hot key."""

import random

import pytest
from pyspark.sql import functions as F

from vigilframe.operators import ordering, threats


@pytest.fixture(scope="module")
def events():
    rng = random.Random(7)
    # Key "hot" holds most rows; sequence numbers have gaps.
    seq, rows = 0, []
    for _ in range(3000):
        seq += rng.choice([1, 1, 1, 2, 40])
        rows.append((seq, "hot" if rng.random() < 0.7 else f"k{rng.randrange(40)}", float(rng.choice([10, 30, 50]))))
    return rows


def by_key(rows):
    out = {}
    for seq, key, value in rows:
        out.setdefault(key, []).append((seq, value))
    return out


@pytest.fixture(scope="module")
def frame(spark, events):
    return spark.createDataFrame(events, "seq bigint, key string, v double").repartition(5).cache()


@pytest.mark.parametrize("width", [64, 100_000])
def test_lag(frame, events, width):
    got = {r["seq"]: r["p"] for r in ordering.lag_by_key(frame, ["key"], "seq", "v", "p", width).collect()}
    want = {s: (items[i - 1][1] if i else None) for items in by_key(events).values() for i, (s, _) in enumerate(items)}
    assert got == want


@pytest.mark.parametrize("width", [16, 100_000])
def test_trailing(frame, events, width):
    got = {r["seq"]: r["l"] for r in ordering.trailing_by_key(frame, ["key"], "seq", "v", "l", 12, width).collect()}
    want = {}
    for items in by_key(events).values():
        values = [v for _, v in items]
        for i, (s, _) in enumerate(items):
            want[s] = values[max(0, i - 11): i + 1]
    assert got == want


@pytest.mark.parametrize("keys", [["key"], []])
@pytest.mark.parametrize("levels", [0, 1, 2])
def test_decayed_sum(frame, events, keys, levels):
    got = {r["seq"]: r["s"] for r in ordering.decayed_sum(frame, keys, "seq", "v", "s", levels).collect()}
    groups = by_key(events).values() if keys else [[(s, v) for s, _, v in events]]
    for items in groups:
        state = 0.0
        for s, v in items:
            state = min(100.0, v + state / 2)
            assert got[s] == pytest.approx(state, abs=1e-9)


def test_segments_and_index_are_worked_out_once(spark, frame):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    flat, deep = (plan(ordering.decayed_sum(frame, ["key"], "seq", "v", "s", levels)) for levels in (0, 1))
    assert deep.count("collect_list") == flat.count("collect_list") > 0
    rows = frame.selectExpr("seq", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, seq) AS ts", "key AS src_ip", "IF(v > 30, 'ALERT', 'INFO') AS severity")
    jumps = threats.level_jumps(rows)
    assert jumps.count() > 0 and "collect_list" not in plan(jumps)


def test_decayed_sum_last(frame, events):
    got = {r["key"]: r["s"] for r in ordering.decayed_sum_last(frame, ["key"], "seq", F.col("v"), "s").collect()}
    for key, items in by_key(events).items():
        state = 0.0
        for _, v in items:
            state = v + state / 2
        assert got[key] == pytest.approx(state, abs=1e-9)


def replay_suppression(rows):
    texts, levels, kept = {}, {}, set()
    for seq, src, level, text, ms in rows:
        heard, spoke = texts.get((src, text)), levels.get((src, level))
        if heard is not None and ms - heard < 60_000:
            continue
        if spoke is not None and ms - spoke < threats.LEVEL_PAUSE[level]:
            continue
        texts[src, text] = levels[src, level] = ms
        kept.add(seq)
    return kept


@pytest.mark.parametrize("width", [8, 50, 65536])
def test_suppression_across_segments(spark, width):
    rng = random.Random(3)
    ms, rows = 0, []
    for seq in range(600):
        ms += rng.choice([0, 200, 900, 2500])
        rows.append((seq, rng.choice(["a", "a", "b"]), rng.choice(["info", "warning", "critical"]), rng.choice("xyzuvw"), ms))
    df = spark.createDataFrame(rows, "seq bigint, src_ip string, level string, identity string, ms bigint")
    got = ordering.accept_in_order(df, ["src_ip"], "seq", threats.suppression_rule, width)
    assert {r["seq"] for r in got.collect()} == replay_suppression(rows)


def test_suppression_where_time_runs_back(spark, monkeypatch):
    """Nothing is forgotten when each hour starts anew: one state a segment, and no round for each of them."""
    rng = random.Random(4)
    rows = [(seq, rng.choice("aab"), rng.choice(["info", "critical"]), rng.choice("xyz"), seq % 400 * 3000 + rng.randrange(9000)) for seq in range(2400)]
    df = spark.createDataFrame(rows, "seq bigint, src_ip string, level string, identity string, ms bigint")
    labels = []
    fresh = ordering.fresh_path
    monkeypatch.setattr(ordering, "fresh_path", lambda s, label: labels.append(label) or fresh(s, label))
    for width in (50, 65536):
        got = ordering.accept_in_order(df, ["src_ip"], "seq", threats.suppression_rule, width)
        assert {r["seq"] for r in got.collect()} == replay_suppression(rows)
    assert labels.count("ends") + labels.count("redone") <= 16


@pytest.mark.parametrize("hot", [0.0, 0.4])
def test_states_of_many_sources_are_handed_on_seldom(spark, monkeypatch, hot):
    """Many sources are heard at once: a segment takes as many rows as it may, not a few of each sequence span."""
    rng = random.Random(8)
    rows = [(seq, "hot" if rng.random() < hot else f"s{rng.randrange(900)}", rng.choice(["info", "critical"]), rng.choice("xyz"), seq * 40) for seq in range(12_000)]
    df = spark.createDataFrame(rows, "seq bigint, src_ip string, level string, identity string, ms bigint")
    paths, fresh = [], ordering.fresh_path
    monkeypatch.setattr(ordering, "fresh_path", lambda s, label: paths.append((label, fresh(s, label))) or paths[-1][1])
    got = ordering.accept_in_order(df, ["src_ip"], "seq", threats.suppression_rule, width=800, lanes=8)
    assert {r["seq"] for r in got.collect()} == replay_suppression(rows)
    label, path = next(p for p in paths if p[0] == "ends")
    per_lane = [r["n"] for r in spark.read.parquet(path).groupBy(ordering.LANE).agg(F.count("*").alias("n")).collect()]
    assert min(per_lane) <= 4 and max(per_lane) <= (15 if hot else 4)  # 15 each, when a span of 800 numbers was a segment


def test_signals_where_time_runs_back(spark):
    rng = random.Random(6)
    rows = [(seq, rng.choice("ab"), rng.choice(["up", "down"]), seq % 100 * 700 + rng.randrange(2000)) for seq in range(600)]
    df = spark.createDataFrame(rows, "seq bigint, src_ip string, jump string, ms bigint")
    last, want = {}, set()
    for seq, src, jump, ms in rows:
        if src not in last or ms - last[src] > threats.PAUSE[jump]:
            last[src] = ms
            want.add(seq)
    for width in (8, 65536):
        got = ordering.accept_in_order(df, ["src_ip"], "seq", threats._pause_rule, width)
        assert {r["seq"] for r in got.collect()} == want


def test_newest_per_key(frame, events):
    got = ordering.newest_n_per_key(frame, ["key"], 3).collect()
    want = {(k, s) for k, items in by_key(events).items() for s, _ in items[-3:]}
    assert {(r["key"], r["seq"]) for r in got} == want


def test_threat_state_replay(spark):
    rng = random.Random(5)
    rows = [(i, f"ip{rng.randrange(30)}", rng.choice(["Active", "Blocked", "Monitoring"]), rng.random()) for i in range(500)]
    active = blocked = 0
    status, suspicious = {}, set()
    for _, ip, now, _c in rows:
        before = status.get(ip)
        if before == "Active":
            active -= 1
            suspicious.discard(ip)
        elif before == "Blocked":
            blocked -= 1
        if now == "Active":
            active += 1
            suspicious.add(ip)
        elif now == "Blocked":
            blocked += 1
            suspicious.discard(ip)
        else:
            suspicious.add(ip)
        status[ip] = now
    got = threats.threat_stats(spark.createDataFrame(rows, "seq bigint, src_ip string, status string, confidence double")).first()
    assert (got["active_threats"], got["blocked_ips"], got["suspicious_ips"]) == (active, blocked, len(suspicious))


def test_accepted_rows_are_known_by_key_and_order(spark):
    rows = [(1, "b", "info", "x", 0), (2, "b", "info", "x", 1000), (2, "a", "info", "x", 1000), (1 << 60, None, "info", "y", 2000)]
    df = spark.createDataFrame(rows, "seq bigint, src_ip string, level string, identity string, ms bigint")
    got = ordering.accept_in_order(df, ["src_ip"], "seq", threats.suppression_rule).collect()
    assert {(r["seq"], r["src_ip"]) for r in got} == {(1, "b"), (2, "a"), (1 << 60, None)}
