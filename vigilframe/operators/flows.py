"""Flow-record preparation: cleaning, encoding, labels, feature projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vigilframe.functions.text import hash_bucket
from vigilframe.session import fresh_path

LIMIT = 1e9
EDGE_FEATURES = ("packet_length", "protocol", "src_port", "dst_port", "ip_version")
FLOW_FEATURES = ("flow_duration", "pkt_len_mean", "bwd_iat", "flow_bytes_s", "dst_port")


def strip_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def detect_label_column(df: DataFrame, exact_first: bool = False) -> str:
    """First column whose name contains ``label`` (optionally an exact match wins)."""
    names = df.columns
    if exact_first:
        for name in names:
            if name.strip().lower() == "label":
                return name
    for name in names:
        if "label" in name.lower():
            return name
    raise ValueError("no label column")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def finite(value: Column) -> Column:
    """NULL for NaN and for both infinities."""
    x = value.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), value)


def _replace(df: DataFrame, columns: Sequence[str], change) -> DataFrame:
    return df.select(*[change(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def clean_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Infinities and NaN become NULL, NULL becomes 0."""
    return _replace(df, columns, lambda c: F.coalesce(finite(F.col(c)), F.lit(0).cast(df.schema[c].dataType)))


def column_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Means of the finite values, all columns in one pass."""
    return df.agg(*[F.avg(finite(F.col(c))).alias(c) for c in columns])


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-finite and NULL values become the column mean, 0 when there is none."""
    means = column_means(df, columns).select(F.struct(*columns)).scalar()
    rows = df.withColumn("_means", means)
    return _replace(
        rows, columns, lambda c: F.coalesce(finite(F.col(c)), F.col(f"_means.{c}"), F.lit(0.0))
    ).drop("_means")


def clip(df: DataFrame, columns: Sequence[str], limit: float = LIMIT) -> DataFrame:
    """Values beyond the limit become the limit; NULL and NaN stay what they are."""
    def bound(c: str) -> Column:
        x = F.col(c)
        return F.when(x > limit, F.lit(limit)).when(x < -limit, F.lit(-limit)).otherwise(x)

    return _replace(df, columns, lambda c: F.when(F.isnan(F.col(c).cast("double")), F.col(c)).otherwise(bound(c)))


def downcast_float32(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return _replace(df, doubles, lambda c: F.col(c).cast("float"))


def binary_label(label: Column, harmless: Sequence[str] = ("BENIGN",)) -> Column:
    """0 when the label names a harmless class, else 1."""
    calm = F.lit(False)
    for word in harmless:
        calm = calm | F.upper(label).contains(word)
    return F.when(F.coalesce(calm, F.lit(False)), 0).otherwise(1)


def label_codes(df: DataFrame, column: str, cell_chars: int = 4) -> DataFrame:
    """Code of every distinct text: its rank in sort order (values, then counts per prefix)."""
    values = df.select(F.col(column).cast("string").alias(column)).filter(F.col(column).isNotNull()).distinct()
    values = values.withColumn("_cell", F.substring(column, 1, cell_chars))
    cells = values.groupBy("_cell").agg(F.count("*").alias("_c"))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("_cell", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_cell").orderBy(column)) - 1
    return values.join(cells, "_cell").select(column, (F.col("_start") + inside).cast("int").alias("code"))


def label_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns replaced by their codes.

    The codes are written first: Spark then knows their size, and rows of a column with few values
    stay in their partitions instead of meeting in one task for each value.
    """
    for column in columns:
        found, path = label_codes(df, column).withColumnRenamed("code", f"_{column}"), fresh_path(df.sparkSession, "codes")
        found.write.parquet(path)
        codes = df.sparkSession.read.schema(found.schema).parquet(path)
        df = df.join(codes, column, "left").drop(column).withColumnRenamed(f"_{column}", column)
    return df


def strict_numeric_prep(df: DataFrame, label: str) -> DataFrame:
    """Variant preparation: incomplete rows and copies go, only numbers and the label stay."""
    complete = df.na.drop().dropDuplicates()
    numbers = numeric_columns(complete)
    if len(numbers) >= 3:
        kept = [F.col(c) for c in numbers]
    else:
        kept = [F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) for c in df.columns]
    return complete.select(*kept, binary_label(F.col(label), ("BENIGN", "NORMAL")).alias("label"))


def engineered_flow_features(df: DataFrame, duration: str, forward: str, backward: str) -> DataFrame:
    """log1p(duration + 1), and the total of both directions under its customary name."""
    return df.withColumn("flow_duration_log", F.log1p(F.col(duration) + 1)).withColumn(
        "pkt_len_mean", F.coalesce(F.col(forward), F.lit(0)) + F.coalesce(F.col(backward), F.lit(0))
    )


def packet_features(df: DataFrame) -> DataFrame:
    """The five detector features of a packet table; packets without a length are dropped."""
    return df.filter(F.col("length").isNotNull()).select(
        "seq",
        F.col("length").cast("int").alias("packet_length"),
        hash_bucket(F.col("highest_layer")).cast("int").alias("protocol"),
        F.coalesce(F.col("src_port"), F.lit(0)).alias("src_port"),
        F.coalesce(F.col("dst_port"), F.lit(0)).alias("dst_port"),
        F.when(F.col("src_ip").contains(":"), 6).otherwise(4).alias("ip_version"),
    )


def edge_feature_projection(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The five detector features, synthesised when the frame lacks them."""
    if set(EDGE_FEATURES) <= set(df.columns):
        return df.select(*keep, *EDGE_FEATURES)
    length = F.col("Packet Length Mean") if "Packet Length Mean" in df.columns else F.col(df.columns[0])
    port = F.col("Destination Port") if "Destination Port" in df.columns else F.lit(0)
    return df.select(
        *keep, length.cast("double").alias("packet_length"), F.lit(0).alias("protocol"),
        port.alias("src_port"), port.alias("dst_port"), F.lit(4).alias("ip_version"),
    )


def align_features(features: Column, names: Sequence[str]) -> Column:
    """Values of a feature map in model order, missing ones 0."""
    return F.array(*[F.coalesce(F.try_element_at(features, F.lit(n)), F.lit(0.0)) for n in names])


def preprocess(df: DataFrame, label: str, columns: Sequence[str], encode: Sequence[str] = ()) -> DataFrame:
    """Default order: copies out, fill 0, encode, label, impute, clip."""
    rows = clean_numeric(df.dropDuplicates(), columns)
    rows = label_encode(rows, encode) if encode else rows
    rows = rows.withColumn("label", binary_label(F.col(label)))
    # Filled columns leave no gap to impute, and the means would cost a pass over all rows.
    return clip(_replace(rows, columns, lambda c: F.col(c).cast("double")), columns)


def event_feature_value(name: str) -> Column:
    """Model input for one feature name, by the first name pattern that fits."""
    low = name.lower()
    if "confidence" in low:
        return F.col("confidence").cast("decimal(10,4)").cast("string")
    if "vector" in low or "angle" in low:
        return F.col("vector").cast("string")
    if "ip" in low:
        return F.col("ip")
    if "geo" in low:
        return F.coalesce(F.col("geo"), F.lit("unknown"))
    if "time" in low:
        return F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    if "threat" in low or "type" in low:
        return F.col("threat_type")
    if "activity" in low:
        return F.coalesce(F.element_at("activity", -1), F.lit(0)).cast("string")
    return F.lit("0")


def event_to_model_features(df: DataFrame, names: Sequence[str], key: str = "seq") -> DataFrame:
    """Long form (key, feature, value) of the model inputs an event yields."""
    pairs = F.array(*[
        F.struct(F.lit(n).alias("feature"), event_feature_value(n).alias("value")) for n in names
    ])
    return df.select(key, F.inline(pairs))


def join_labels(features: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Features and labels matched by row key, never by position."""
    return features.join(labels, key)
