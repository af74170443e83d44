"""Alert views, per-address threat state, and the decaying threat index."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilframe.functions import bands, coerce, geo
from vigilframe.operators import ordering
from vigilframe.session import written

EMA_GAIN = 10.0  # half of weight times 20


def resolve_as_of(df: DataFrame, as_of: str | None, ts: str = "ts") -> Column:
    """The given instant as a literal (so that scans can prune), else the newest event time."""
    if as_of is not None:
        return F.lit(as_of).cast("timestamp_ntz")
    return df.agg(F.max(ts).cast("timestamp_ntz")).scalar()


def lookback(df: DataFrame, as_of: str | None, minutes: int, ts: str = "ts") -> DataFrame:
    """Events of the last ``minutes``; there is no upper bound."""
    if minutes <= 0:
        raise ValueError("minutes must be positive")
    return df.filter(F.col(ts) >= resolve_as_of(df, as_of, ts) - F.expr(f"interval {int(minutes)} minutes"))


def minute(ts: Column) -> Column:
    return F.date_trunc("minute", ts).cast("timestamp_ntz")


def alerts_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("severity") == "ALERT")


def log_view(df: DataFrame, limit: int = 200, show_info: bool = True) -> DataFrame:
    """Newest rows as shown in the log: message fallback and a detail line."""
    newest = ordering.newest_n(df, max(1, limit), ("id",))
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    percent = F.concat(F.lit("confidence "), F.round("confidence").cast("bigint").cast("string"), F.lit("%"))
    detail = F.concat_ws(" • ", percent, part("src ", F.col("src_ip")), part("dst ", F.col("dst_ip")))
    view = newest.select(
        "id", "timestamp", F.coalesce("threat", "message", F.lit("Event received")).alias("message"),
        F.when(detail != "", detail).alias("detail"), bands.severity_log_view(F.col("type")).alias("severity"),
    )
    return view if show_info else view.filter(F.col("severity") != "info")


def normalise_threat_events(df: DataFrame) -> DataFrame:
    """Display defaults, clamped numbers and the display id of a threat event."""
    tidy = df.withColumns({
        "ip": F.coalesce("ip", F.lit("0.0.0.0")),
        "threat_type": F.coalesce("threat_type", F.lit("Unknown")),
        "status": F.coalesce("status", F.lit("Monitoring")),
        "confidence": bands.clamp(F.coalesce("confidence", F.lit(0.0)), 0, 1),
        "vector": bands.clamp(F.coalesce("vector", F.lit(0.0)), 0, 360),
    })
    return tidy.withColumn("id", F.concat_ws("-", "ip", "timestamp"))


# --- state per address -------------------------------------------------------------------

def latest_status(df: DataFrame) -> DataFrame:
    """Latest status per address, with the sums the averages need (partial aggregation)."""
    return df.groupBy("src_ip").agg(
        F.max_by("status", "seq").alias("status"), F.sum("confidence").alias("confidence_sum"),
        F.count("confidence").alias("events"),
    )


def stats_of_latest(latest: DataFrame) -> DataFrame:
    return latest.agg(
        F.count_if(F.col("status") == "Active").alias("active_threats"),
        F.count_if(F.col("status") == "Blocked").alias("blocked_ips"),
        F.count_if(F.col("status") != "Blocked").alias("suspicious_ips"),
        F.round(F.coalesce(F.try_divide(F.sum("confidence_sum"), F.sum("events")), F.lit(0.0)), 2).alias("avg_confidence"),
    )


def threat_stats(df: DataFrame) -> DataFrame:
    """Counters after all events: they only depend on the latest status of each address."""
    return stats_of_latest(latest_status(df))


def status_transition(df: DataFrame) -> DataFrame:
    return ordering.lag_by_key(df.select("seq", "src_ip", "status"), ["src_ip"], "seq", "status", "previous")


def activity_history(df: DataFrame, k: int = 12) -> DataFrame:
    """The last ``k`` confidences of each address, in whole percent."""
    pct = df.select("seq", "src_ip", F.floor(bands.clamp(F.col("confidence"), 0, 1) * 100 + 0.5).cast("int").alias("pct"))
    return ordering.trailing_by_key(pct, ["src_ip"], "seq", "pct", "activity", k)


def dominant_vector(df: DataFrame) -> DataFrame:
    """The most frequent whole angle, its newest place; ties go to the angle seen first."""
    angle = F.floor(F.col("vector") + 0.5).cast("int")
    return (
        df.groupBy(angle.alias("angle"))
        .agg(F.count("*").alias("count"), F.max_by("dst_ip", "seq").alias("geo"), F.min("seq").alias("first_seq"))
        .orderBy(F.col("count").desc(), "first_seq").limit(1).select("angle", "count", "geo")
    )


# --- threat index ------------------------------------------------------------------------

def index_contribution(severity: Column) -> Column:
    return coerce.severity_weight(severity) * EMA_GAIN


def threat_index_per_source(df: DataFrame) -> DataFrame:
    """The index after every event of each source."""
    rows = df.select("seq", "ts", "src_ip", index_contribution(F.col("severity")).alias("_w"))
    return ordering.decayed_sum(rows, ["src_ip"], "seq", "_w", "threat_index").drop("_w")


def threat_index_trajectory(df: DataFrame) -> DataFrame:
    """The global index after every event."""
    rows = df.select("seq", index_contribution(F.col("severity")).alias("_w"))
    return ordering.decayed_sum(rows, [], "seq", "_w", "threat_index").drop("_w")


def threat_index_final(df: DataFrame, per_source: bool = False) -> DataFrame:
    """The index after the newest event, over all events or for each source."""
    return ordering.decayed_sum_last(
        df, ["src_ip"] if per_source else [], "seq", index_contribution(F.col("severity")), "threat_index"
    )


def threat_index_snapshot(df: DataFrame) -> DataFrame:
    final = threat_index_final(df)
    count = df.agg(F.count("*")).scalar()
    return final.select(
        F.round("threat_index", 2).alias("threat_index"), bands.threat_band(F.col("threat_index")).alias("status"),
        count.alias("count"),
    )


def cumulative_counter(df: DataFrame, as_of: str | None, minutes: int = 5, keep: int = 100) -> DataFrame:
    """Running event number of the newest ``keep`` events inside the window."""
    total = df.agg(F.count("*")).scalar()
    back = F.row_number().over(Window.orderBy(F.col("seq").desc())) - 1
    newest = ordering.newest_n(df.select("seq", "ts"), keep).withColumn("_back", back)
    cut = resolve_as_of(df, as_of) - F.expr(f"interval {int(minutes)} minutes")
    numbered = newest.withColumn("total", total).filter(F.col("ts") >= cut)
    return numbered.select("seq", "ts", (F.col("total") - F.col("_back")).alias("value"))


# Jump sizes and the pause after a signal, in milliseconds.
JUMP_UP, JUMP_DOWN = 15, 20
PAUSE = {"up": 2500, "down": 4000}


def level_jumps(df: DataFrame) -> DataFrame:
    """Rises of at least 15 and falls of at least 20 of the index against the sample before.

    The level before the first sample is 0.
    """
    # Written once: the rows and the ends of their segments would each work out the index anew.
    index = written(threat_index_per_source(df), "index")
    lagged = ordering.lag_by_key(index, ["src_ip"], "seq", "threat_index", "previous")
    change = F.round(F.col("threat_index") - F.coalesce("previous", F.lit(0.0)), 6)
    return (
        lagged.withColumn("change", change)
        .withColumn("jump", F.when(change >= JUMP_UP, "up").when(change <= -JUMP_DOWN, "down"))
        .filter(F.col("jump").isNotNull())
        .select("seq", "src_ip", "jump", "change", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    )


def _pause_rule(rows: pd.DataFrame, last: dict, horizon: float) -> tuple[list[bool], dict]:
    """``last`` holds the time of each source's last signal, as long as a time from ``horizon`` on may need it."""
    mask = []
    for src, ms, jump in zip(rows["src_ip"].tolist(), rows["ms"].tolist(), rows["jump"].tolist()):
        ok = src not in last or ms - last[src] > PAUSE[jump]
        mask.append(ok)
        if ok:
            last[src] = ms
    longest = max(PAUSE.values())
    return mask, {src: at for src, at in last.items() if horizon - at <= longest}


def level_signals(df: DataFrame) -> DataFrame:
    """Jumps that sound: not within the pause after the last one that did."""
    return ordering.accept_in_order(level_jumps(df), ["src_ip"], "seq", _pause_rule).select("seq", "src_ip", "jump")


# Alert repetition window, pause per level, order of levels.
REPEAT_MS = 60_000
LEVEL_PAUSE = {"info": 5_000, "warning": 3_000, "critical": 1_000}
LEVEL_ORDER = ("critical", "warning", "info")


def suppression_rule(rows: pd.DataFrame, sources: dict, horizon: float | None = None) -> tuple[list[bool], dict]:
    """Accept unless this text or this level of the source was accepted too recently.

    ``sources`` maps a source to its last times by text and by level. What no time from ``horizon``
    on (by default the time of the last row) can need is forgotten.
    """
    mask, ms = [], 0
    columns = (rows[c].tolist() for c in ("src_ip", "ms", "level", "identity"))
    for src, ms, level, text in zip(*columns):
        texts, levels = sources.setdefault(src, ({}, {}))
        heard, spoke = texts.get(text), levels.get(level)
        ok = (heard is None or ms - heard >= REPEAT_MS) and (spoke is None or ms - spoke >= LEVEL_PAUSE[level])
        mask.append(ok)
        if ok:
            texts[text] = levels[level] = ms
    until = ms if horizon is None else horizon
    live = {}
    for src, (texts, levels) in sources.items():
        texts = {t: at for t, at in texts.items() if until - at < REPEAT_MS}
        levels = {v: at for v, at in levels.items() if until - at < LEVEL_PAUSE[v]}
        if texts or levels:
            live[src] = (texts, levels)
    return mask, live


def alert_messages(df: DataFrame) -> DataFrame:
    """Spoken alerts: their level, their identity and their time in milliseconds."""
    level = F.when(F.col("severity").isin("ALERT", "CRITICAL"), "critical").when(
        F.col("severity").isin("WARNING", "HIGH"), "warning").otherwise("info")
    return df.select(
        "seq", "src_ip", level.alias("level"), F.lower("label").alias("identity"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
    )


def suppress_alerts(messages: DataFrame, concise: bool = False) -> DataFrame:
    """Messages that pass repetition and level pauses, kept per source address."""
    heard = messages.filter("level = 'critical'") if concise else messages
    kept = ordering.accept_in_order(heard, ["src_ip"], "seq", suppression_rule)
    rank = F.array_position(F.array(*[F.lit(v) for v in LEVEL_ORDER]), F.col("level")) - 1
    return kept.select("seq", "src_ip", "level", "identity", "ms", rank.cast("int").alias("priority"))


def retain_arcs(df: DataFrame, as_of: str | None, ttl_seconds: int = 8, keep: int = 100) -> DataFrame:
    """Newest arcs young enough to draw, with both end points."""
    young = df.filter(F.col("ts") >= resolve_as_of(df, as_of) - F.expr(f"interval {int(ttl_seconds)} seconds"))
    newest = ordering.newest_n(young.filter("src_ip is not null or dst_ip is not null"), keep)
    return newest.select(
        "seq", "src_ip", "dst_ip",
        geo.ip_lat(F.col("src_ip")).alias("src_lat"), geo.ip_lon(F.col("src_ip")).alias("src_lon"),
        geo.ip_lat(F.col("dst_ip")).alias("dst_lat"), geo.ip_lon(F.col("dst_ip")).alias("dst_lon"),
    )
