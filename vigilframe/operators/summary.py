"""The rolling attack summary and everything derived from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilframe.functions import bands, coerce, geo
from vigilframe.functions.text import percent
from vigilframe.operators.threats import lookback, minute, resolve_as_of

TOP = 10


def with_attack(df: DataFrame) -> DataFrame:
    flag = coerce.is_attack(F.col("is_attack"), coerce.first_text(F.col("label"), F.col("status")), F.col("severity"))
    return df.withColumn("attack", flag)


def top_k(df: DataFrame, column: str, k: int | None = TOP, newest_first: bool = True, extra: Sequence[Column] = ()) -> DataFrame:
    """Most frequent values. Ties: the value seen last (newest-first lists) or seen first."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(column).agg(
        F.count("*").alias("count"), F.max("seq").alias("_last"), F.min("seq").alias("_first"), *extra
    )
    tie = F.col("_last").desc() if newest_first else F.col("_first").asc()
    ordered = counted.orderBy(F.col("count").desc(), tie)
    return (ordered.limit(k) if k else ordered).drop("_last", "_first")


def spine(df: DataFrame, as_of: str | None, minutes: int) -> DataFrame:
    """The last ``minutes`` whole minutes up to ``as_of``, one row each."""
    end = minute(resolve_as_of(df, as_of))
    start = end - F.expr(f"interval {int(minutes) - 1} minutes")
    step = F.expr("interval 1 minute")
    return df.sparkSession.range(1).select(F.explode(F.sequence(start, end, step)).alias("minute"))


def timeline(df: DataFrame, as_of: str | None, minutes: int) -> DataFrame:
    """Zero-filled event counts per minute; an older partial minute is not listed."""
    counts = lookback(df, as_of, minutes).groupBy(minute(F.col("ts")).alias("minute")).agg(F.count("*").alias("count"))
    filled = spine(df, as_of, minutes).join(counts, "minute", "left")
    return filled.select("minute", F.coalesce("count", F.lit(0)).alias("count"))


def totals(df: DataFrame, as_of: str | None, minutes: int) -> DataFrame:
    return lookback(df, as_of, minutes).agg(
        F.count("*").alias("total_events"),
        F.round(F.count_if("attack") / minutes, 2).alias("attack_rate"),
    )


def protocol_mix(df: DataFrame) -> DataFrame:
    """Counts of every protocol, largest first."""
    named = df.withColumn("proto", F.coalesce(F.upper("proto"), F.lit("UNKNOWN")))
    return top_k(named, "proto", None)


def grouped_counts(df: DataFrame, as_of: str | None, minutes: int) -> DataFrame:
    """All counts of the summary in one scan and one shuffle: (part, value, count, last).

    Grouping sets aggregate partially, so the shuffle carries one row per value and task.
    """
    window = lookback(df, as_of, minutes).select(
        "src_ip", F.col("dst_port").cast("string").alias("dst_port"), F.coalesce(F.upper("proto"), F.lit("UNKNOWN")).alias("proto"),
        F.date_format(minute(F.col("ts")), "yyyy-MM-dd HH:mm").alias("minute"), "attack", "seq",
    )
    parts = ["src_ip", "dst_port", "proto", "minute"]
    cube = window.groupingSets(
        [[F.col(p)] for p in parts] + [[]], *[F.col(p) for p in parts]
    ).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("count"), F.max("seq").alias("last"),
        F.count_if("attack").alias("attacks"),
    )
    # grouping_id sets the bits of the columns that are absent.
    names = F.when(F.col("gid") == 7, "src_ip").when(F.col("gid") == 11, "dst_port").when(
        F.col("gid") == 13, "proto").when(F.col("gid") == 14, "minute").otherwise("total")
    return cube.select(
        names.alias("part"), F.coalesce(*parts).alias("value"), "count", "last", "attacks"
    )


def _listed(part: str) -> Column:
    """Ordered (value, count) pairs of one part, largest first, newest first among equals."""
    pairs = F.collect_list(F.when(
        (F.col("part") == part) & F.col("value").isNotNull(),
        F.struct((-F.col("count")).alias("a"), (-F.col("last")).alias("b"), "value", "count"),
    ))
    return F.transform(F.sort_array(pairs), lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count")))


def attack_summary(df: DataFrame, as_of: str | None, minutes: int) -> DataFrame:
    """The whole summary as one row: rate, total, ordered top lists and the timeline."""
    counts = grouped_counts(df, as_of, minutes)
    # The limit is the same for every group, so that it also applies before the shuffle and
    # no task sorts all sources. Values of the unlimited parts are groups of their own.
    limited = F.col("part").isin("src_ip", "dst_port")
    group = F.when(limited, F.col("part")).otherwise(F.concat_ws(":", "part", "value"))
    order = Window.partitionBy("_group").orderBy(F.col("value").isNull(), F.col("count").desc(), F.col("last").desc())
    ranked = counts.withColumn("_group", group).withColumn("rank", F.row_number().over(order))
    kept = ranked.filter(F.col("rank") <= TOP)
    total = F.col("part") == "total"
    one = kept.agg(
        F.coalesce(F.max(F.when(total, F.col("count"))), F.lit(0)).alias("total_events"),
        F.coalesce(F.round(F.max(F.when(total, F.col("attacks"))) / minutes, 2), F.lit(0.0)).alias("attack_rate"),
        _listed("src_ip").alias("top_ips"), _listed("dst_port").alias("top_ports"),
        _listed("proto").alias("protocols"), _listed("minute").alias("_minutes"),
    )
    end = minute(resolve_as_of(df, as_of))
    labels = F.sequence(end - F.expr(f"interval {int(minutes) - 1} minutes"), end, F.expr("interval 1 minute"))

    def bucket(at: Column) -> Column:
        same = F.filter("_minutes", lambda m: m["value"] == F.date_format(at, "yyyy-MM-dd HH:mm"))
        return F.struct(
            F.date_format(at, "HH:mm").alias("minute"),
            F.coalesce(F.try_element_at(same, F.lit(1))["count"], F.lit(0)).alias("count"),
        )

    return one.withColumn("timeline", F.transform(labels, bucket)).drop("_minutes")


# --- derived from top lists -----------------------------------------------------------------

def share_of_total(top: DataFrame, total: DataFrame) -> DataFrame:
    """Each listed count as a share of the total; ``total`` has one row and one column."""
    return top.withColumn("share", F.col("count") / F.greatest(total.scalar(), F.lit(1)))


def bar_percent(top: DataFrame) -> DataFrame:
    """Bar length against the largest count."""
    peak = top.agg(F.max("count")).scalar()
    return top.withColumn("percent", F.least(F.lit(100.0), F.col("count") / F.greatest(peak, F.lit(1)) * 100))


def threat_table_from_summary(df: DataFrame, as_of: str | None, minutes: int) -> DataFrame:
    """Rows of the threat table: share of the listed sources, band, commonest protocol and port."""
    window = lookback(df, as_of, minutes)
    top = top_k(window, "src_ip")
    total = top.agg(F.sum("count")).scalar()
    port = top_k(window, "dst_port", 1).select(F.col("dst_port").cast("string")).scalar()
    proto = top_k(window, "proto", 1).select("proto").scalar()
    weight = F.col("count") / F.greatest(F.col("_total"), F.lit(1))
    rows = top.withColumns({"_total": total, "_port": port, "_proto": proto})
    return rows.select(
        F.col("src_ip").alias("ip"),
        F.concat_ws(" ", F.coalesce("_proto", F.lit("Unknown")), F.coalesce("_port", F.lit("--"))).alias("threat_type"),
        F.round(weight * 100).cast("int").alias("confidence"),
        F.concat(F.lit("Weight "), percent(weight * 100)).alias("geo"),
        bands.share_status(weight).alias("status"),
    ).orderBy(F.col("confidence").desc())


def threat_table_from_rows(df: DataFrame, keep: int = 40) -> DataFrame:
    """Given table rows with defaults, best confidence first."""
    rows = df.select(
        F.coalesce("ip", F.concat(F.lit("unknown-"), F.col("seq").cast("string"))).alias("ip"),
        F.coalesce("threat_type", F.lit("Unknown")).alias("threat_type"),
        F.floor(F.coalesce("confidence", F.lit(0.0)) + 0.5).cast("int").alias("confidence"),
        F.coalesce("geo", F.lit("—")).alias("geo"), F.coalesce("status", F.lit("ONLINE")).alias("status"), "seq",
    )
    return rows.orderBy(F.col("confidence").desc(), "seq").limit(keep)


def geo_points(top: DataFrame, ip: str = "src_ip") -> DataFrame:
    """Map points of an ordered top list: place by address and position in the list."""
    position = F.row_number().over(Window.orderBy(F.col("count").desc(), F.col(ip))) - 1
    ranked = top.withColumn("rank", position)
    return ranked.select(
        F.concat(F.lit("geo-"), F.col(ip)).alias("id"), F.col(ip).alias("ip"),
        geo.pseudo_lat(F.col(ip), F.col("rank")).alias("latitude"), geo.pseudo_lon(F.col(ip), F.col("rank")).alias("longitude"),
        F.greatest(F.lit(1), F.col("count")).alias("intensity"),
    )


def geo_top(points: DataFrame, keep: int = 30) -> DataFrame:
    """Strongest points, intensity scaled to the peak and kept within .2 and 1."""
    peak = points.agg(F.max("intensity")).scalar()
    strongest = points.orderBy(F.col("intensity").desc(), "ip").limit(keep)
    return strongest.withColumn("intensity", bands.clamp(F.col("intensity") / F.greatest(peak, F.lit(1)), 0.2, 1.0))


def live_points(alerts: DataFrame, points: int = 25, rows: int = 10) -> DataFrame:
    """Newest alerts for the map, the very newest flagged for the table."""
    newest = alerts.orderBy(F.col("seq").desc()).limit(points)
    back = F.row_number().over(Window.orderBy(F.col("seq").desc()))
    numbered = newest.withColumn("_back", back)
    total = F.count("*").over(Window.partitionBy(F.lit(1)))
    placed = numbered.withColumn("_index", total - F.col("_back"))
    ip = F.coalesce("src_ip", F.concat(F.lit("unknown-"), F.col("_index").cast("string")))
    return placed.select(
        "seq", ip.alias("ip"), geo.pseudo_lat(ip, F.col("_index")).alias("latitude"),
        geo.pseudo_lon(ip, F.col("_index")).alias("longitude"), (F.col("_back") <= rows).alias("in_table"),
    )


def summary_kpis(df: DataFrame, as_of: str | None, minutes: int) -> DataFrame:
    s = attack_summary(df, as_of, minutes)
    rate = F.col("attack_rate")
    return s.select(
        F.col("total_events").alias("active_threats"),
        F.coalesce(F.try_element_at("top_ports", F.lit(1))["count"], F.lit(0)).alias("blocked_attacks"),
        F.size("top_ips").alias("suspicious_ips"),
        F.when(rate != 0, bands.clamp(rate * 10, 5, 99)).alias("avg_confidence"),
    )


def live_alert_kpis(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count("*").alias("active_threats"),
        F.floor(F.count("*") * 0.65 + 0.5).cast("bigint").alias("blocked_attacks"),
        F.count_distinct("src_ip").alias("suspicious_ips"),
    )


def merge_kpis(api: DataFrame, live: DataFrame) -> DataFrame:
    """The given counters, with the larger of both suspicious counts."""
    seen = live.select("suspicious_ips").scalar()
    return api.withColumn("suspicious_ips", F.greatest("suspicious_ips", F.coalesce(seen, F.lit(0))))


def source_fallback(*sources: DataFrame) -> DataFrame:
    """All rows of the first source that has any (same columns in every source)."""
    tagged = [s.withColumn("_priority", F.lit(i)) for i, s in enumerate(sources)]
    together = tagged[0]
    for more in tagged[1:]:
        together = together.unionByName(more)
    # An existence probe of one row per source decides; no source is counted.
    probes = [s.select(F.lit(i).alias("_priority")).limit(1) for i, s in enumerate(sources)]
    present = probes[0]
    for more in probes[1:]:
        present = present.unionByName(more)
    return together.filter(F.col("_priority") == present.agg(F.min("_priority")).scalar()).drop("_priority")


# --- alert frequency -------------------------------------------------------------------------

def attack_frequency_alerts(alerts: DataFrame, as_of: str | None, minutes: int) -> DataFrame:
    """Alerts per minute label in the window, with the total and the unrounded rate."""
    per = lookback(alerts, as_of, minutes).groupBy(F.date_format("ts", "HH:mm").alias("minute")).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))
    return per.withColumn("total_events", total).withColumn("attack_rate", F.col("total_events") / minutes)


def per_minute(df: DataFrame) -> DataFrame:
    return df.groupBy(minute(F.col("ts")).alias("minute")).agg(F.count("*").alias("count"))


# Chart windows in minutes.
CHART_WINDOWS = {"1M": 1, "5M": 5, "1H": 60}


def attack_frequency_window(points: DataFrame, as_of: str | None, window: str) -> DataFrame:
    """Total of the points in a chart window and its average per minute."""
    span = CHART_WINDOWS[window]
    kept = lookback(points, as_of, span, "minute")
    n = F.count("*")
    return kept.agg(
        F.lit(window).alias("window"), n.alias("points"), F.coalesce(F.sum("count"), F.lit(0)).alias("total_events"),
        F.when(n > 0, F.sum("count") / F.greatest(n, F.lit(span))).otherwise(0.0).alias("average_per_minute"),
    )


def spike_states(buckets: DataFrame) -> DataFrame:
    """For each minute of a zero-filled timeline: spike, cooled or steady against the mean of all minutes before.

    The timeline's length, an argument of ``timeline``, bounds the rows of the window.
    """
    before = Window.orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    mean, n = F.avg("count").over(before), F.count("count").over(before)
    state = (
        F.when(n < 1, "steady")
        .when((F.col("count") > mean * 1.5) & (F.col("count") >= 3), "spike")
        .when((F.col("count") <= mean * 0.5) & (mean > 0), "cooled").otherwise("steady")
    )
    return buckets.select("minute", "count", state.alias("state"))


def recent_spike(buckets: DataFrame, last: int = 3, least: int = 5) -> DataFrame:
    """The earliest of the newest minutes that reaches the threshold."""
    newest = buckets.orderBy(F.col("minute").desc()).limit(last)
    return newest.filter(F.col("count") >= least).orderBy("minute").limit(1)


def recent_activity(buckets: DataFrame, last: int = 6) -> DataFrame:
    """Counts of the newest minutes as one array, oldest first."""
    newest = buckets.orderBy(F.col("minute").desc()).limit(last)
    pairs = F.sort_array(F.collect_list(F.struct("minute", "count")))
    return newest.agg(F.transform(pairs, lambda p: p["count"]).alias("activity"))


def attack_trends(df: DataFrame, as_of: str | None, minutes: int = 15) -> DataFrame:
    """Attacks per minute of the last quarter hour, with the change to the quarter before."""
    end = minute(resolve_as_of(df, as_of))
    recent = lookback(df.filter("attack"), as_of, 2 * minutes)
    counts = recent.groupBy(minute(F.col("ts")).alias("minute")).agg(F.count("*").alias("count"))
    both = spine(df, as_of, 2 * minutes).join(counts, "minute", "left").select("minute", F.coalesce("count", F.lit(0)).alias("count"))
    newer = F.col("minute") > end - F.expr(f"interval {minutes} minutes")
    partner = both.filter(~newer).select((F.col("minute") + F.expr(f"interval {minutes} minutes")).alias("minute"), F.col("count").alias("_old"))
    return both.filter(newer).join(partner, "minute", "left").select(
        "minute", F.col("count").alias("attacks"), (F.col("count") - F.coalesce("_old", F.lit(0))).alias("change")
    )


def incidents_overview(df: DataFrame, predicted: Column, least: int = 5) -> DataFrame:
    """Attack events, repeated (source, label) patterns, and alarms on benign labels."""
    per = df.groupBy("src_ip", "label").agg(
        F.count_if("attack").alias("n"), F.count_if(predicted & (F.col("label") == "benign")).alias("fp")
    )
    return per.agg(
        F.sum("n").alias("incidents_logged"), F.count_if(F.col("n") >= least).alias("patterns_detected"),
        F.sum("fp").alias("false_positives"),
    )


def feed_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("messages"), F.max_by("ts", "seq").alias("newest"))
