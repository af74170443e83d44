"""Distribution of one feature: clipped histogram, percentiles, moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.operators import exact

LOW, HIGH = 0.01, 0.99
SHOWN = (0.1, 0.25, 0.5, 0.75, 0.9)


def bounds_and_percentiles(df: DataFrame, feature: str) -> DataFrame:
    """One row: n, the 1 % and 99 % bounds, and percentiles of the clipped values.

    Clipping is monotone, so percentiles of the clipped values come from the clipped order
    statistics of the raw ones, and all ranks are found together.
    """
    stats = exact.order_statistics(df, feature, (LOW, *SHOWN, HIGH))

    def order_pair(p: float, field: str) -> Column:
        return F.max(F.when(F.col("p") == p, F.col(field)))

    names = {LOW: "lo", HIGH: "hi", **{p: f"p{round(p * 100)}" for p in SHOWN}}
    one = stats.agg(
        F.max("n").alias("n"),
        *[order_pair(p, f).alias(f"{names[p]}_{f}") for p in names for f in ("lo_v", "hi_v")],
    )

    def at(p: float, low: Column, high: Column) -> Column:
        return exact.interpolate(F.col("n"), F.lit(p), low, high)

    ends = one.withColumn("lo", at(LOW, F.col("lo_lo_v"), F.col("lo_hi_v"))).withColumn(
        "hi", at(HIGH, F.col("hi_lo_v"), F.col("hi_hi_v")))
    clip = lambda c: F.greatest(F.col("lo"), F.least(F.col("hi"), c))
    return ends.select(
        "n", "lo", "hi",
        *[at(p, clip(F.col(f"{names[p]}_lo_v")), clip(F.col(f"{names[p]}_hi_v"))).alias(names[p]) for p in SHOWN],
    )


def clipped(df: DataFrame, feature: str) -> DataFrame:
    """The feature's values within the bounds, next to the histogram's shape."""
    b = bounds_and_percentiles(df, feature).select(F.struct("n", "lo", "hi").alias("b")).scalar()
    rows = df.select(F.col(feature).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    rows = rows.withColumn("b", b)
    flat = F.col("b.lo") == F.col("b.hi")
    return rows.select(
        F.greatest(F.col("b.lo"), F.least(F.col("b.hi"), F.col("v"))).alias("v"),
        F.least(F.lit(30), F.greatest(F.lit(10), F.floor(F.sqrt("b.n")))).cast("int").alias("bins"),
        F.when(flat, F.col("b.lo") - 0.5).otherwise(F.col("b.lo")).alias("lo"),
        F.when(flat, F.col("b.hi") + 0.5).otherwise(F.col("b.hi")).alias("hi"),
    )


def histogram(df: DataFrame, feature: str) -> DataFrame:
    """Equal-width counts of the clipped values: (bin, edge, count), the last bin closed."""
    rows = clipped(df, feature)
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    place = F.least(F.col("bins") - 1, F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins"))).cast("int")
    counts = rows.groupBy(place.alias("bin")).agg(
        F.count("*").alias("count"), F.first("bins").alias("bins"), F.first("lo").alias("lo"), F.first(width).alias("width")
    )
    # At most 30 bins: fold them into one map and spread it again to fill the gaps.
    folded = counts.agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("m"),
        *[F.max(c).alias(c) for c in ("bins", "lo", "width")],
    )
    spread = folded.select("m", "lo", "width", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    return spread.select(
        "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("edge"),
        F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0)).alias("count"),
    )


def moments(df: DataFrame, feature: str) -> DataFrame:
    return clipped(df, feature).agg(
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")
    )
