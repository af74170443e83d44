"""Model importance tables: parsing, scaling, ranking, comparing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilframe.functions import bands


def parse_importance_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """``name,score`` lines; blanks, short lines and non-numbers (so headers too) drop out."""
    parts = F.split(F.col(line), ",")
    score = F.trim(F.get(parts, F.lit(1))).try_cast("double")
    return df.select(*[c for c in df.columns if c != line], F.trim(parts[0]).alias("name"), score.alias("score")).filter(
        (F.trim(line) != "") & F.col("score").isNotNull()
    )


_DICTS = "array<struct<feature:string,name:string,importance:double,value:double>>"


def parse_importance_json(df: DataFrame, keys: Sequence[str], raw: str = "raw") -> DataFrame:
    """Importance lists of metrics documents: objects, pairs, or an equal split of the model's features."""
    doc = F.try_parse_json(F.col(raw))
    given = lambda path, kind: F.try_variant_get(doc, path, kind)

    def objects(field: str) -> Column:
        items = given(f"$.{field}", _DICTS)
        named = F.transform(items, lambda x: F.struct(
            F.coalesce(x["feature"], x["name"]).alias("name"),
            F.coalesce(F.nullif(x["importance"], F.lit(0.0)), x["value"], x["importance"]).alias("score")))
        return F.filter(named, lambda x: x["name"].isNotNull() & x["score"].isNotNull())

    def pairs(field: str) -> Column:
        items = given(f"$.{field}", "array<array<string>>")
        named = F.transform(F.filter(items, lambda x: F.size(x) >= 2), lambda x: F.struct(
            x[0].alias("name"), x[1].try_cast("double").alias("score")))
        return F.filter(named, lambda x: x["score"].isNotNull())

    def filled(items: Column) -> Column:
        return F.when(F.size(items) > 0, items)

    names = F.coalesce(given("$.realtime_model.features", "array<string>"), given("$.model.features", "array<string>"))
    equal = F.transform(names, lambda n: F.struct(n.alias("name"), (F.lit(1.0) / F.size(names)).alias("score")))
    chosen = F.coalesce(
        *[filled(part(f)) for f in ("feature_importance", "importance") for part in (objects, pairs)], equal
    )
    items = df.select(*keys, F.posexplode(chosen).alias("pos", "i"))
    return items.select(*keys, "pos", F.col("i.name").alias("name"), F.col("i.score").alias("score"))


def normalise_importance(df: DataFrame) -> DataFrame:
    """Absolute score against the largest one."""
    peak = df.agg(F.max(F.abs("score"))).scalar()
    return df.withColumn("_peak", peak).select(
        *df.columns, (F.abs("score") / F.when(F.col("_peak") > 0, F.col("_peak")).otherwise(1.0)).alias("normalized_score")
    )


def importance_rank(df: DataFrame) -> DataFrame:
    """Display rank and percentage with one decimal of a (small) importance table."""
    order = Window.orderBy(F.col("normalized_score").desc(), "name")
    return df.select(
        "name", F.row_number().over(order).alias("display_rank"),
        (F.floor(F.round(F.col("normalized_score") * 1000, 6) + 0.5) / 10).alias("normalized_percent"),
    )


def top_feature_signals(df: DataFrame, k: int) -> DataFrame:
    """The strongest ``k`` features and whether each is rising or elevated."""
    if not 1 <= k <= 32:
        raise ValueError("k must lie within 1 and 32")
    top = df.orderBy(F.col("normalized_score").desc(), "name").limit(k)
    rank = F.row_number().over(Window.orderBy(F.col("normalized_score").desc(), "name"))
    return top.select(
        rank.alias("rank"), F.col("name").alias("feature"), bands.signal(F.col("normalized_score")).alias("signal"),
        F.col("normalized_score").alias("score"),
    )


def top10_importance(df: DataFrame, k: int = 10) -> DataFrame:
    top = df.orderBy(F.col("score").desc(), "name").limit(k)
    return top.select("name", F.round(F.col("score") * 100, 1).alias("percent"))


def importance_delta(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Change of the scaled score against an earlier snapshot, 0 for new features."""
    old = previous.select("name", F.col("normalized_score").alias("_old"))
    return current.join(old, "name", "left").select(
        "name", "normalized_score", F.coalesce(F.col("normalized_score") - F.col("_old"), F.lit(0.0)).alias("delta")
    )


def merge_feature_sources(summary: DataFrame, importance: DataFrame) -> DataFrame:
    """The model summary's list when it has rows (percentages become fractions), else the importance list."""
    from vigilframe.operators.summary import source_fallback

    share = F.when(F.col("importance") > 1, F.col("importance") / 100).otherwise(F.coalesce("importance", F.lit(0.0)))
    named = summary.filter(F.coalesce("name", F.lit("")) != "").select("name", share.alias("importance"))
    return source_fallback(named, importance.select("name", "importance")).orderBy(F.col("importance").desc())


def weighted_attribution(importance: DataFrame, baseline: DataFrame, observed: DataFrame, key: str = "row_id") -> DataFrame:
    """(value - baseline) * weight per row and feature; ``observed`` is long (row, name, value).

    Missing values fall back to the baseline, missing baselines to 0.
    """
    weights = importance.select("name", F.col("score").alias("weight")).join(
        baseline.select("name", F.col("value").alias("baseline")), "name", "left"
    ).withColumn("baseline", F.coalesce("baseline", F.lit(0.0)))
    known = weights.agg(
        F.map_from_entries(F.collect_list(F.struct("name", F.struct("weight", "baseline")))).alias("m")
    ).scalar()
    seen = F.map_from_entries(F.collect_list(F.struct("name", "value")))
    rows = observed.groupBy(key).agg(seen.alias("seen")).withColumn("known", known)
    parts = rows.select(key, "seen", F.explode("known").alias("feature", "w"))
    value = F.coalesce(F.try_element_at("seen", F.col("feature")), F.col("w.baseline"))
    return parts.select(key, "feature", F.round((value - F.col("w.baseline")) * F.col("w.weight"), 6).alias("value"))


def top_attributions(contributions: DataFrame, depth: int = 8, key: str = "row_id") -> DataFrame:
    """Strongest contributions of each row by size, flagged by sign."""
    order = Window.partitionBy(key).orderBy(F.abs("value").desc(), "feature")
    ranked = contributions.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth)
    return ranked.select(key, "feature", "value", "rank", (F.col("value") >= 0).alias("positive"))


def uniform_importance(df: DataFrame) -> DataFrame:
    """Equal shares: 100/n rounded to 2 decimals, and 1/n."""
    n = df.agg(F.count("*")).scalar()
    return df.withColumn("_n", n).select(
        "name", F.round(F.lit(100.0) / F.col("_n"), 2).alias("percent"), (F.lit(1.0) / F.col("_n")).alias("share")
    )


def histogram_density(histogram: DataFrame) -> DataFrame:
    total = histogram.agg(F.sum("count")).scalar()
    return histogram.withColumn("_t", total).select(
        *histogram.columns, (F.col("count") / F.when(F.col("_t") > 0, F.col("_t")).otherwise(1)).alias("density")
    )
