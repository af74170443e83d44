"""Exact order statistics and exact hash-ordered splits without a global sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def order_statistics(df: DataFrame, value: str, ps: Sequence[float], accuracy: int = 100_000) -> DataFrame:
    """For each p the two neighbouring order statistics around (n-1)p: (p, n, lo_v, hi_v).

    An approximate sketch first brackets every wanted rank. One more pass counts what lies
    below each bracket and the distinct values inside it, which is a sliver of the data, so
    the exact ranks come from a window over that sliver only.
    """
    clean = df.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    margin = 3.0 / accuracy
    lows = [max(0.0, p - margin) for p in ps]
    highs = [min(1.0, p + margin) for p in ps]
    sketch = clean.agg(
        F.count("*").alias("n"),
        F.percentile_approx("v", lows + highs, accuracy).alias("at"),
        F.min("v").alias("least"), F.max("v").alias("most"),
    )
    # Too few rows for the margin to span whole ranks: the bracket is everything.
    few = F.col("n") * margin < 4
    bounds = sketch.select(
        F.struct(
            "n",
            F.array(*[
                F.struct(
                    F.lit(float(p)).alias("p"),
                    (F.col("least") if low == 0 else F.when(few, F.col("least")).otherwise(F.col("at")[i])).alias("lo"),
                    (F.col("most") if high == 1 else F.when(few, F.col("most")).otherwise(F.col("at")[len(ps) + i])).alias("hi"),
                )
                for i, (p, low, high) in enumerate(zip(ps, lows, highs))
            ]).alias("brackets"),
        ).alias("b")
    )
    rows = clean.select("v", bounds.scalar().alias("b"))
    hits = rows.select(
        "v", F.col("b.n").alias("n"), F.explode(F.filter("b.brackets", lambda x: F.col("v") <= x["hi"])).alias("k")
    )
    inside = F.when(F.col("v") >= F.col("k.lo"), F.col("v"))
    counts = hits.groupBy(F.col("k.p").alias("p"), inside.alias("v")).agg(
        F.count("*").alias("c"), F.first("n").alias("n")
    )
    ordered = Window.partitionBy("p").orderBy(F.col("v").asc_nulls_first())
    ranked = counts.withColumn("upto", F.sum("c").over(ordered)).withColumn("start", F.col("upto") - F.col("c"))
    low_rank = F.floor((F.col("n") - 1) * F.col("p"))
    high_rank = F.least(low_rank + 1, F.col("n") - 1)

    def at(rank: Column) -> Column:
        here = (F.col("start") <= rank) & (rank < F.col("upto"))
        return F.max(F.when(here, F.coalesce(F.col("v"), F.raise_error(F.lit("rank left its bracket")).cast("double"))))

    return ranked.groupBy("p").agg(
        F.first("n").alias("n"), at(low_rank).alias("lo_v"), at(high_rank).alias("hi_v")
    )


def interpolate(n: Column, p: Column, lo: Column, hi: Column) -> Column:
    """Linear interpolation between two order statistics."""
    h = (n - 1) * p
    return lo + (hi - lo) * (h - F.floor(h))


def percentiles(df: DataFrame, value: str, ps: Sequence[float]) -> DataFrame:
    """Exact interpolated percentiles: (p, value)."""
    stats = order_statistics(df, value, ps)
    return stats.select("p", interpolate(F.col("n"), F.col("p"), F.col("lo_v"), F.col("hi_v")).alias("value"))


def hash_slots(
    df: DataFrame, classes: Sequence[str], key: Sequence[str], cuts, seed: int = 42, out: str = "slot",
    cell_digits: int = 4,
) -> DataFrame:
    """Rank rows of a class by a keyed hash and number the slots between cut ranks.

    ``cuts(n)`` gives an array column of ascending cut ranks for a class of ``n`` rows; slot
    0 lies before the first cut. Counts per hash cell tell the cell each cut runs through;
    only rows of those cells are sent and ranked. ``key`` must be unique, and the classes few:
    their cuts, one row a class, go to every task.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key])
    rows = df.withColumn("_h", F.md5(text)).withColumn("_cell", F.substring("_h", 1, cell_digits))
    group = [*classes, "_cell"]
    ordered = Window.partitionBy(*classes).orderBy("_cell")
    whole = Window.partitionBy(*classes)
    cells = (
        rows.groupBy(*group).agg(F.count("*").alias("_c"))
        .withColumn("_upto", F.sum("_c").over(ordered))
        .withColumn("_all", cuts(F.sum("_c").over(whole)))
        .withColumn("_start", F.col("_upto") - F.col("_c"))
    )
    # A cut is the cell it runs through and the rows of that cell before it; cuts behind the last row cut nothing.
    here = F.filter("_all", lambda c: (c >= F.col("_start")) & (c < F.col("_upto")))
    found = F.transform(here, lambda c: F.struct(F.col("_cell").alias("cell"), (c - F.col("_start")).alias("before")))
    placed = rows.join(F.broadcast(cells.groupBy(*classes).agg(F.flatten(F.collect_list(found)).alias("_cuts"))), list(classes))
    through = F.exists("_cuts", lambda c: (c["cell"] == F.col("_cell")) & (c["before"] > 0))

    def slot_of(rank: Column) -> Column:
        return F.size(F.filter("_cuts", lambda c: (c["cell"] < F.col("_cell")) | ((c["cell"] == F.col("_cell")) & (c["before"] <= rank))))

    drop = ["_h", "_cell", "_cuts"]
    clear = placed.filter(~through).withColumn(out, slot_of(F.lit(0))).drop(*drop)
    ranked = F.row_number().over(Window.partitionBy(*group).orderBy("_h", *key))
    split = placed.filter(through).withColumn("_rank", ranked - 1).withColumn(out, slot_of(F.col("_rank"))).drop(*drop, "_rank")
    return clear.unionByName(split)


def sample_exact(df: DataFrame, classes: Sequence[str], key: Sequence[str], frac: float, seed: int = 42) -> DataFrame:
    """Exactly round(frac * n) rows of every class."""
    cut = hash_slots(df, classes, key, lambda n: F.array(F.round(n * frac).cast("bigint")), seed)
    return cut.filter("slot = 0").drop("slot")


def sample_n(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in hash order (all rows when there are fewer)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key])
    return df.withColumn("_h", F.md5(text)).orderBy("_h", *key).limit(n).drop("_h")


def stratified_split(df: DataFrame, label: str, key: Sequence[str], train: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds ``part`` = train or test, with the class ratio kept exactly."""
    cut = hash_slots(df, [label], key, lambda n: F.array(F.round(n * train).cast("bigint")), seed)
    return cut.withColumn("part", F.when(F.col("slot") == 0, "train").otherwise("test")).drop("slot")


def stratified_folds(df: DataFrame, label: str, key: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold`` 0..k-1, each fold holding an equal share of every class."""
    def cuts(n: Column) -> Column:
        return F.array(*[F.floor(n * i / k).cast("bigint") for i in range(1, k)])

    return hash_slots(df, [label], key, cuts, seed, out="fold")
