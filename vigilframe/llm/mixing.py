"""Mixing sources to target weights with Pareto order sampling, in DataFrame operations only.

Every document gets an expected number of copies; the whole part is certain, and the fraction
is an inclusion probability. Documents of a source are ranked by random odds over inclusion
odds and taken in that order until the source's words are spent. Only sums per source and per
rank cell are shuffled: the cut is found in the one cell of a source that it runs through, and
a document compares its own rank with its source's cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.llm.words import has_rows, settle

WORD = "[^\\x20\\x09-\\x0D]+"
CELLS = 1 << 16  # rank cells of a source
BLOCK = 1 << 8  # cells of a block
FEW = 100_000  # source rows of under 100 bytes that are sent to all tasks; with more, adaptive execution picks the join


def size_of(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def level_of(size: Column) -> Column:
    """Bits of the size: the preference for longer documents grows by one when the size doubles."""
    return F.length(F.bin(size)).cast("long")


def random_odds(doc_id: Column, row: Column) -> Column:
    """u / (1 - u) of a number drawn by the id, so that reruns agree, and by the row number where it isn't unique."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(F.concat(F.lit(":"), row.cast("string")), F.lit("")))
    drawn = F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double")
    u = (drawn + 0.5) / F.lit(4503599627370496.0)
    return u / (1 - u)


def numbered(rows: DataFrame) -> DataFrame:
    """Adds row: a number for each row without an id or with one that others have; null elsewhere.

    Only these rows are settled, so that their numbers stay; the others are known by their ids.
    """
    again = settle(rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    alone, several = rows.where("doc_id is not null"), rows.where("doc_id is null")
    if has_rows(again):
        several = several.unionByName(alone.join(again, "doc_id", "left_semi").select(*rows.columns))
        alone = alone.join(again, "doc_id", "left_anti").select(*rows.columns)
    several = settle(several.withColumn("row", F.monotonically_increasing_id()))
    return alone.withColumn("row", F.lit(None).cast("long")).unionByName(several)


def drawn(rows: DataFrame) -> DataFrame:
    return rows.withColumn("level", level_of(F.col("size"))).withColumn("odds", random_odds(F.col("doc_id"), F.col("row")))


def place_of() -> Column:
    """What orders the documents of a source: rank, then what tells equal ranks apart."""
    return F.struct("rank", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "size", F.coalesce("row", F.lit(-1)).alias("row"))


def targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Adds each source's target: a share by weight of all sizes, at most `most` times its own.

    Sources come in code-point order, null last, and take the weights in turn. Filled up in
    order of cap over weight, the level (words per unit of weight) is highest at the last
    source that stays at its cap. The table has one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    rows = sources.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(most * F.sum("source_size").over(fill), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fill), F.lit(0)))
    return (
        rows.withColumn("level", level).withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least(most * F.col("source_size").cast("double"), F.col("weight") * F.col("level")))
        .drop("level", "weight")
    )


def ranked(rows: DataFrame, most: int) -> DataFrame:
    """Adds whole (certain copies), rank (odds ratio, null where nothing is left to chance) and cell."""
    ratio = F.col("target") / F.col("source_size")
    spread = F.col("high") - F.col("low")
    tilt = F.when(spread > 0, (F.col("level") - F.col("level_sum") / F.col("source_size")) / spread).otherwise(F.lit(0.0))
    expected = F.when(F.col("source_size") > 0, F.greatest(F.lit(0.0), F.least(
        F.lit(float(most)), ratio + F.least(ratio, most - ratio) * tilt))).otherwise(F.lit(0.0))
    rows = rows.withColumn("expected", expected).withColumn("whole", F.floor("expected").cast("long"))
    rest = F.col("expected") - F.col("whole")
    rank = F.when((rest > 0) & (F.col("size") > 0), F.col("odds") / (rest / (1 - rest)))
    return rows.withColumn("rank", rank).withColumn(
        "cell", F.floor(F.col("rank") / (1 + F.col("rank")) * CELLS).cast("int"))


def mixing_plan(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row per source: sums, target, and the place (see place_of) of the last document taken."""
    sources = targets(sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("level")).alias("level_sum"),
        F.min("level").alias("low"), F.max("level").alias("high")), weights, most)
    sources = settle(sources)
    rows = ranked(by_source(sized, sources), most)
    cells = settle(rows.groupBy("source", "cell").agg(
        F.coalesce(F.sum(F.when(F.col("rank").isNotNull(), F.col("size"))), F.lit(0)).alias("words"),
        F.sum(F.col("whole") * F.col("size")).alias("certain"), F.first("target").alias("target"),
    ).withColumn("block", F.floor(F.col("cell") / BLOCK).cast("int")))
    budget = cells.groupBy("source").agg((F.first("target") - F.sum("certain")).alias("left"))
    blocks = crossing(by_source(cells.where("cell is not null").groupBy("source", "block").agg(
        F.sum("words").alias("words"), F.lit(0).cast("long").alias("before")), budget), "block")
    inner = by_source(cells, blocks.withColumnRenamed("block", "cut_block")).where("block = cut_block")
    cut = crossing(inner, "cell").withColumnRenamed("cell", "cut_cell")
    crossed = by_source(rows, cut).where("cell = cut_cell")
    inside = Window.partitionBy("source").orderBy(place_of())
    last = (
        crossed.withColumn("end", F.col("before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("end") - F.col("size") / 2 <= F.col("left"))
        .groupBy("source").agg(F.max(place_of()).alias("last"))
    )
    # Each side has a name of its own for the key: a drop by column would take the left side's away.
    return settle(
        sources.join(cut.withColumnRenamed("source", "cut_source"), F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")
        .join(last.withColumnRenamed("source", "last_source"), F.col("source").eqNullSafe(F.col("last_source")), "left").drop("last_source"))


def crossing(sums: DataFrame, key: str) -> DataFrame:
    """The first block or cell of each source at which the words taken pass those left.

    At most 256 rows of a source are ordered: first its blocks, then the cells of one block.
    """
    upto = Window.partitionBy("source").orderBy(key)
    after = sums.withColumn("after", F.col("before") + F.sum("words").over(upto))
    return settle(after.where("after > left").groupBy("source", "left").agg(
        F.min(key).alias(key), F.min_by(F.col("after") - F.col("words"), key).alias("before")))


def by_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Joins with a table of one row per source, sent to all tasks while it is small."""
    table = table.withColumnRenamed("source", "__source")
    if table.count() <= FEW:
        table = F.broadcast(table)
    return rows.join(table, rows["source"].eqNullSafe(table["__source"])).drop("__source")


def with_copies(sized: DataFrame, plan: DataFrame, most: int = 3) -> DataFrame:
    """Adds copies to rows that have doc_id, source, size, row, level and odds."""
    rows = ranked(by_source(sized, plan), most)
    taken = F.col("rank").isNotNull() & (
        F.col("cut_cell").isNull() | (F.col("cell") < F.col("cut_cell")) | ((F.col("cell") == F.col("cut_cell")) & (place_of() <= F.col("last"))))
    return rows.withColumn("copies", F.col("whole") + F.coalesce(taken, F.lit(False)).cast("long"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words times copies), copies, source.

    Null or empty text has size 0 and is never drawn by chance; a source without words has
    target 0. A null source is a source of its own, ordered last. Rows without an id, or with one
    that others have, are drawn each by itself, by a row number: which of equal rows is taken may
    depend on how the input is split. An empty table gives no rows. Other columns are not read.
    """
    sized = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size_of(F.col("text")).alias("size")))
    sized = drawn(numbered(sized))
    rows = with_copies(sized, mixing_plan(sized, weights, most), most)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; columns stay as they are."""
    names = docs.columns
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("__row"), F.col("doc_id").cast("long").alias("doc_id"),
                         "source", size_of(F.col("text")).alias("size"))
    packed = numbered(packed)
    small = settle(packed.select("doc_id", "source", "size", "row"))
    rows = with_copies(drawn(packed), mixing_plan(drawn(small), weights, most), most)
    return rows.where("copies > 0").select("__row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("__copy")).select(
        *[F.col("__row")[c].alias(c) for c in names])
