"""The one-row dashboard document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.operators import health, narrative, summary, threats


def dashboard(events: DataFrame, hosts: DataFrame, importance: DataFrame, as_of: str | None, minutes: int) -> DataFrame:
    """Threat, system, store, model and summary parts in one row, each a one-row subquery."""
    at = threats.resolve_as_of(events, as_of)
    doc = summary.attack_summary(events, as_of, minutes)
    text = narrative.incident_narrative(doc, at, minutes)
    system = health.latest_samples(hosts).agg(
        F.round(F.avg("cpu"), 2).alias("cpu_percent"), F.round(F.avg("memory"), 2).alias("memory_percent"),
        F.round(F.avg("latency_ms"), 2).alias("latency_ms"),
    )
    one = lambda df: df.select(F.struct("*")).scalar()
    return doc.select(F.struct("*").alias("summary")).withColumns({
        "narrative": text.scalar(), "threat": one(threats.threat_index_snapshot(events)), "system": one(system),
        "store": one(health.cache_hit_rate(hosts)),
        "model": one(importance.agg(F.count("*").alias("features"), F.lit("loaded").alias("status"))),
        "generated_at": at, "minutes": F.lit(minutes),
    })
