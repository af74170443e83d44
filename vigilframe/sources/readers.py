"""File sources, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilframe.operators import ordering
from vigilframe.sources.following import follow_lines

LOG_GLOB = "detection_log_*.txt"


def scan_flow_csvs(spark: SparkSession, folder: str, schema: T.StructType | str | None = None, glob: str = "*.csv") -> DataFrame:
    """All CSV files of a folder, united by column name, with a ``file_id``.

    Each file's own header names its columns, whatever their order; a column that a file lacks
    is NULL there. Without a schema, types come from all rows of the files that share a header.
    With one, lines that don't fit it are kept in ``_corrupt_record``. Files that can't be read
    are skipped; ``skipped_csvs`` lists them. No file at all is an error.
    """
    headers = csv_headers(spark, folder, glob)
    by_header = headers.groupBy("header").agg(F.collect_list("file_id").alias("files")).orderBy("header").collect()
    if not by_header:
        raise FileNotFoundError(f"no readable CSV files in {folder}")
    wanted = None
    if schema is not None:
        wanted = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    united = None
    for row in by_header:
        reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("ignoreCorruptFiles", True)
        names = reader.csv(row["files"][0]).columns
        if wanted is None:
            found = reader.option("inferSchema", True).csv(row["files"])
        else:
            types = {f.name: f.dataType for f in wanted.fields}
            fields = [T.StructField(n, types.get(n, T.StringType())) for n in names]
            fields.append(T.StructField(CORRUPT, T.StringType()))
            found = reader.schema(T.StructType(fields)).option("columnNameOfCorruptRecord", CORRUPT).csv(row["files"])
        found = found.select(*[F.col(f"`{c}`") for c in found.columns], F.col("_metadata.file_path").alias("file_id"))
        united = found if united is None else united.unionByName(found, allowMissingColumns=True)
    return united


CORRUPT = "_corrupt_record"


def csv_headers(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """(file_id, header) of the CSV files that can be read and are not empty."""
    lines = spark.read.option("pathGlobFilter", glob).option("ignoreCorruptFiles", True).text(folder).select(
        F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), "value")
    return lines.where("block = 0").groupBy("file_id").agg(F.min_by("value", "place").alias("header"))


def skipped_csvs(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """The CSV files of a folder that are not empty but have no header to read: they are broken."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    files = listing.select(F.col("path").alias("file_id"))
    name = F.regexp_replace("file_id", "^file:/+", "/")
    read = csv_headers(spark, folder, glob).select(name.alias("_name"))
    return files.join(read, name == F.col("_name"), "left_anti")


def read_log_dir(spark: SparkSession, folder: str, glob: str = LOG_GLOB) -> DataFrame:
    """Log lines with file, time of the file's last change, and a position that orders the file."""
    lines = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(folder)
    return lines.select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("modified"),
        # Lines of one split are read in order; splits of a file are ordered by their start.
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"),
    )


def log_files(lines: DataFrame) -> DataFrame:
    """The files of a log scan, newest first."""
    return lines.groupBy("file", "modified").agg(F.count("*").alias("lines")).orderBy(F.col("modified").desc(), "file")


def latest_log_only(spark: SparkSession, folder: str, glob: str = LOG_GLOB) -> DataFrame:
    """Lines of the newest file. Its name comes from file listings alone, so that the scan reads that file only."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    newest = listing.select("path", "modificationTime").orderBy(F.col("modificationTime").desc(), F.col("path").desc()).first()
    if newest is None:
        raise FileNotFoundError(f"no {glob} in {folder}")
    return read_log_dir(spark, newest["path"], "*")


def last_lines(lines: DataFrame, n: int = 200) -> DataFrame:
    """The last ``n`` lines of each file, numbered from the file's end (1 = last)."""
    ordered = lines.withColumn("_order", F.struct("block", "place"))
    from pyspark.sql.window import Window

    back = F.row_number().over(Window.partitionBy("file").orderBy(F.col("_order").desc()))
    return ordered.withColumn("from_end", back).filter(F.col("from_end") <= n).drop("_order")


def scan_importance_csv(spark: SparkSession, path: str) -> DataFrame:
    from vigilframe.operators.importance import parse_importance_lines

    return parse_importance_lines(spark.read.text(path).withColumnRenamed("value", "line"))


def scan_detections(df: DataFrame, tail: int = 25, line: str = "line", order: str = "seq") -> DataFrame:
    """``time type ip rest`` lines; shorter ones are skipped; the newest ``tail`` in order."""
    parts = F.split(F.col(line), " ", 4)
    rows = df.filter(F.size(parts) == 4).select(
        order, parts[0].alias("time"), parts[1].alias("type"), parts[2].alias("ip"), parts[3].alias("rest")
    )
    return ordering.newest_n_in_order(rows, tail, (order,))


def telemetry_source(
    spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet", files_per_batch: int = 10
) -> DataFrame:
    """Unbounded read of appended event files, oldest first, a few files per micro-batch."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )


def log_tail_source(spark: SparkSession, folder: str, glob: str = LOG_GLOB, start: str = "earliest") -> DataFrame:
    """Unbounded read of log lines: those appended to a file as well as those of newer files, each once."""
    return follow_lines(spark, folder, glob, start).select("line")
