"""Threshold and label mappings shown next to the metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def threat_band(index: Column) -> Column:
    return (
        F.when(index >= 80, "critical").when(index >= 60, "high")
        .when(index >= 30, "elevated").when(index >= 10, "low").otherwise("normal")
    )


def threat_band_dashboard(index: Column) -> Column:
    return F.when(index >= 80, "critical").when(index >= 60, "high").otherwise("normal")


def threat_band_metrics(index: Column) -> Column:
    return F.when(index >= 80, "critical").when(index >= 50, "warn").otherwise("normal")


def threat_band_ui(level: Column, status: Column) -> Column:
    named = F.lower(status)
    return (
        F.when(named.isin("critical", "high"), "critical")
        .when(named.isin("warn", "warning", "elevated"), "warn")
        .when(named.isin("normal", "idle", "nominal"), "normal")
        .when(level >= 70, "critical").when(level >= 30, "warn").otherwise("normal")
    )


def clamp(value: Column, low: float, high: float) -> Column:
    # greatest and least skip NULL, so a missing value must be kept out of them.
    return F.when(value.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))


def rescale_index(index: Column, count: Column) -> Column:
    """Fractions become percentages; a silent index falls back to 8.5 per event."""
    scaled = clamp(F.when(index <= 1, index * 100).otherwise(index), 0, 100)
    return F.when((scaled == 0) & (count > 0), F.least(F.lit(100.0), count * 8.5)).otherwise(scaled)


def gauge_value(alerts: Column, value: Column) -> Column:
    """Ten points per alert, else the given value, within 0..100."""
    computed = F.when(alerts > 0, F.least(F.lit(100.0), alerts * 10.0))
    return clamp(F.coalesce(computed, value, F.lit(0.0)), 0, 100)


def severity_ui(*candidates: Column) -> Column:
    level = F.lower(F.coalesce(*candidates, F.lit("info")))
    return (
        F.when(level == "alert", "ALERT").when(level.isin("warning", "warn"), "WARNING")
        .when(level == "normal", "NORMAL").otherwise("INFO")
    )


def severity_log_view(level: Column) -> Column:
    low = F.lower(F.coalesce(level, F.lit("")))
    return F.when(low.isin("alert", "critical"), "alert").when(low == "warning", "warning").otherwise("info")


def probability_severity(p: Column) -> Column:
    return F.when(p > 0.7, "high").when(p > 0.4, "medium").otherwise("low")


def health_status(status: Column) -> Column:
    low = F.lower(status)
    return (
        F.when(F.coalesce(status, F.lit("")) == "", "unknown")
        .when(low.contains("ok") | low.contains("online"), "online")
        .when(low.contains("warn") | low.contains("degrad"), "degraded")
        .when(low.contains("off"), "offline").otherwise("unknown")
    )


def freshness_label(age_seconds: Column) -> Column:
    whole = F.floor(age_seconds)
    return (
        F.when(whole < 5, "live").when(whole < 60, F.format_string("%ds ago", whole))
        .otherwise(F.format_string("%dm ago", F.floor(whole / 60)))
    )


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 80, "Stable").when(confidence < 50, "Unstable").otherwise("Caution")


def gpu_band(load: Column) -> Column:
    return F.when(load > 85, "critical").when(load > 65, "warning").otherwise("normal")


def threat_status(status: Column) -> Column:
    """Title case, and anything but Active, Blocked or Monitoring is Monitoring."""
    named = F.initcap(F.trim(status))
    return F.when(named.isin("Active", "Blocked", "Monitoring"), named).otherwise("Monitoring")


def highlight_threat(confidence: Column, status: Column) -> Column:
    return (confidence >= 0.8) | (F.lower(status) == "active")


def share_status(weight: Column) -> Column:
    return F.when(weight > 0.35, "CRITICAL").when(weight > 0.2, "WARNING").otherwise("ONLINE")


def signal(normalized: Column) -> Column:
    return F.when(normalized > 0.65, "rising").otherwise("elevated")


def anomaly_label(score: Column) -> Column:
    return F.when(score >= 0.5, "ANOMALY").otherwise("NORMAL")
