"""Host health: warning rules and fleet roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.functions.text import fixed, percent
from vigilframe.operators import ordering

# Warning thresholds.
WARN_CPU, WARN_MEMORY, WARN_DISK_FREE, WARN_LATENCY_MS = 90.0, 85.0, 10.0, 150.0


def health_warnings(df: DataFrame) -> DataFrame:
    """Adds ``warnings``, the messages that apply to a sample."""
    down = F.col("status") == "offline"
    checks = F.array(
        F.when(F.col("cpu") >= WARN_CPU, F.concat(F.lit("High CPU load detected ("), percent(F.col("cpu")), F.lit(")."))),
        F.when(F.col("memory") >= WARN_MEMORY, F.concat(F.lit("Elevated memory utilisation ("), percent(F.col("memory")), F.lit(")."))),
        F.when(down, F.lit("Store connection lost.")).when(
            F.col("latency_ms") > WARN_LATENCY_MS, F.concat(F.lit("Store latency elevated ("), fixed(F.col("latency_ms"), 0), F.lit("ms)."))),
        F.when(F.col("disk_free_percent") <= WARN_DISK_FREE,
               F.concat(F.lit("Low disk space: "), percent(F.col("disk_free_percent")), F.lit(" free ("), fixed(F.col("disk_free_gb"), 1), F.lit(" GB)."))),
    )
    return df.withColumn("warnings", F.filter(checks, lambda m: m.isNotNull()))


def cache_hit_rate(df: DataFrame) -> DataFrame:
    hits, total = F.sum("hits"), F.sum("hits") + F.sum("misses")
    return df.agg(
        (hits / F.greatest(total, F.lit(1))).alias("hit_rate"),
        F.when(total > 0, F.round(hits / total * 100, 2)).otherwise(0.0).alias("hit_percent"),
    )


def latest_samples(df: DataFrame) -> DataFrame:
    """The newest sample of each host."""
    rest = [c for c in df.columns if c != "host"]
    newest = df.groupBy("host").agg(F.max_by(F.struct(*rest), "seq").alias("_row"))
    return newest.select("host", *[F.col(f"_row.{c}").alias(c) for c in rest])


def fleet_status_counts(df: DataFrame) -> DataFrame:
    states = ("online", "warning", "maintenance")
    return df.agg(*[F.count_if(F.col("status") == s).alias(s) for s in states])


def highest_cpu_node(df: DataFrame) -> DataFrame:
    """The busiest host; of equal ones the first."""
    return df.orderBy(F.col("cpu").desc(), "host").limit(1).select("host", "cpu")


def metric_history(df: DataFrame, keep: int = 60) -> DataFrame:
    """The newest samples of each host, non-finite values 0."""
    def finite(c: str):
        bad = F.isnan(c) | F.col(c).isNull() | (F.abs(c) == float("inf"))
        return F.when(bad, 0.0).otherwise(F.col(c)).alias(c)

    newest = ordering.newest_n_per_key(df, ["host"], keep)
    return newest.select("seq", "host", "ts", finite("cpu"), finite("memory"), "latency_ms")
