"""Counters over detection-log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.functions import logtext
from vigilframe.operators import ordering
from vigilframe.operators.threats import minute


def parse_lines(df: DataFrame, as_of: Column, line: str = "line") -> DataFrame:
    """Both layouts; a line without a readable time counts at ``as_of`` with parse_ok false."""
    # The generator keeps filters on parsed fields from repeating the pattern match.
    rows = df.withColumn("_parts", F.explode(F.array(logtext.full_parts(F.col(line)))))
    full, legacy = logtext.full_fields(F.col("_parts")), logtext.legacy_fields(F.col(line))
    chosen = {n: F.when(F.col("_parts").isNotNull(), full[n]).otherwise(legacy[n]) for n in full}
    fields = rows.select(*df.columns, *[c.alias(n) for n, c in chosen.items()])
    return fields.select(
        *df.columns, *[n for n in chosen if n != "timestamp"],
        F.coalesce("timestamp", as_of).alias("ts"), F.col("timestamp").isNotNull().alias("parse_ok"),
        logtext.category(F.col("traffic_type")).alias("category"),
    )


def packet_totals(parsed: DataFrame) -> DataFrame:
    attack = F.col("category") == "attack"
    return parsed.agg(
        F.count("*").alias("total_packets"), F.count_if(attack).alias("attack_packets"),
        F.greatest(F.count("*") - F.count_if(attack), F.lit(0)).alias("normal_packets"),
        F.count_distinct(F.when(attack, F.col("src_ip"))).alias("unique_ips_blocked"),
    )


def minute_breakdown(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy(minute(F.col("ts")).alias("minute")).agg(
        F.count_if(F.col("category") == "attack").alias("attack"), F.count_if(F.col("category") == "normal").alias("normal")
    )


def blocked_ip_counts(parsed: DataFrame) -> DataFrame:
    hits = parsed.filter((F.col("category") == "attack") & F.col("src_ip").isNotNull())
    return hits.groupBy("src_ip").agg(F.count("*").alias("count"))


def attack_history(parsed: DataFrame, limit: int | None = None, held: int = 1000) -> DataFrame:
    """The newest attack lines, at most ``limit`` of the ``held`` ones, in arrival order."""
    attacks = parsed.filter(F.col("category") == "attack")
    newest = ordering.newest_n_in_order(attacks, min(limit or held, held))
    return newest.select("seq", "ts", "src_ip", "src_port", "dst_ip", "dst_port", F.col("traffic_type").alias("description"))


def blocklist(scored: DataFrame) -> DataFrame:
    """Attacking sources with first and last sighting and hits."""
    hits = scored.filter("attack").filter(F.col("src_ip").isNotNull() & (F.col("src_ip") != "Unknown"))
    return hits.groupBy("src_ip").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("hits"))
