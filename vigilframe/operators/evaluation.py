"""Quality of scored rows (label, prediction, score)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilframe.session import fresh_path


def confusion_matrix(df: DataFrame) -> DataFrame:
    """Counts of the four (label, prediction) cells, empty ones 0."""
    cells = df.sparkSession.sql("SELECT * FROM VALUES (0, 0), (0, 1), (1, 0), (1, 1) c(label, prediction)")
    counts = df.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    return cells.join(counts, ["label", "prediction"], "left").select("label", "prediction", F.coalesce("n", F.lit(0)).alias("n"))


def accuracy(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))


def auc_roc(df: DataFrame, score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Exact rank-based area under the curve, ties counted half.

    Rows collapse to counts per distinct score. The counts of smaller negatives are a prefix
    sum, taken over range partitions of the scores first and then inside each. Spark keeps
    those even however the scores crowd together; they are written once, so that both
    sides of the prefix sum see the same ones.
    """
    counts = df.groupBy(*by, F.col(score).alias("s")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    ranged = counts.repartitionByRange("s").withColumn("_cell", F.spark_partition_id())
    path = fresh_path(df.sparkSession, "scores")
    ranged.write.parquet(path)
    per = df.sparkSession.read.schema(ranged.schema).parquet(path)
    sums = per.groupBy(*by, "_cell").agg(F.sum("neg").alias("_neg"))
    earlier = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_cell", F.coalesce(F.sum("_neg").over(earlier), F.lit(0)).alias("_below"))
    inside = Window.partitionBy(*by, "_cell").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = per.join(sums, [*by, "_cell"]).withColumn(
        "below", F.col("_below") + F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return ranked.groupBy(*by).agg(
        F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("auc")
    )


def classification_report(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, then macro and weighted means."""
    counts = df.groupBy("label", "prediction").agg(F.count("*").alias("n"))

    def part(kind: int) -> DataFrame:
        hit = F.coalesce(F.sum(F.when((F.col("label") == kind) & (F.col("prediction") == kind), F.col("n"))), F.lit(0))
        said = F.coalesce(F.sum(F.when(F.col("prediction") == kind, F.col("n"))), F.lit(0))
        true = F.coalesce(F.sum(F.when(F.col("label") == kind, F.col("n"))), F.lit(0))
        return counts.agg(
            F.lit(str(kind)).alias("class"), F.coalesce(F.try_divide(hit, said), F.lit(0.0)).alias("precision"),
            F.coalesce(F.try_divide(hit, true), F.lit(0.0)).alias("recall"), true.alias("support"),
        )

    p, r = F.col("precision"), F.col("recall")
    classes = part(0).unionByName(part(1)).withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))

    def mean(name: str, weight: Column) -> DataFrame:
        total = F.sum(weight)
        return classes.agg(
            F.lit(name).alias("class"), *[(F.sum(F.col(c) * weight) / total).alias(c) for c in ("precision", "recall", "f1")],
            F.sum("support").alias("support"),
        )

    return classes.unionByName(mean("macro avg", F.lit(1.0))).unionByName(mean("weighted avg", F.col("support")))


def cv_summary(folds: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean and population deviation of the fold metrics."""
    return folds.agg(*[f(c).alias(f"{c}_{n}") for c in metrics for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def class_balance(df: DataFrame, label: str, sample_fraction: float, note: str) -> DataFrame:
    """Rows per class next to the dataset profile."""
    features = len([c for c in df.columns if c != label])
    per = df.groupBy(label).agg(F.count("*").alias("rows"))
    total = F.sum("rows").over(Window.partitionBy(F.lit(1)))
    return per.select(
        F.col(label).cast("string").alias("class"), "rows", total.alias("total_rows"), F.lit(features).alias("total_features"),
        F.lit(sample_fraction).alias("sample_fraction"), F.lit(note).alias("note"),
    )
