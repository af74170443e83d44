"""File sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_features_labels(df: DataFrame, path: str, features: Sequence[str], label: str, keep: Sequence[str] = (), csv: bool = False) -> None:
    """Features with the label in the same row (CSV only on request)."""
    out = df.select(*keep, *features, label).write.mode("overwrite")
    out.option("header", True).csv(path) if csv else out.parquet(path)


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    """A one-row metrics document."""
    metrics.write.mode("overwrite").json(path)


def write_importance_csv(importance: DataFrame, path: str) -> None:
    """``name,score,normalized_score``, strongest first."""
    ranked = importance.select("name", "score", "normalized_score").orderBy(F.col("score").desc(), "name")
    ranked.write.mode("overwrite").option("header", True).csv(path)


def write_distribution_csv(histogram: DataFrame, path: str) -> None:
    """``bucket,count`` of a histogram."""
    histogram.select(F.col("edge").alias("bucket"), "count").write.mode("overwrite").option("header", True).csv(path)


def write_log_lines(lines: DataFrame, path: str, column: str = "line") -> None:
    lines.select(column).write.mode("append").text(path)
