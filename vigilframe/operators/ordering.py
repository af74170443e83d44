"""Order-dependent operators that stay parallel when one key holds most rows.

A plain ``Window.partitionBy(key)`` puts every row of a key into one task. The operators
here cut each key into segments of ``width`` consecutive sequence numbers, work inside
(key, segment) groups of at most ``width`` rows, and pass the little state that crosses a
segment border through per-segment summaries. The row-level shuffle is the one on
(key, segment), shared by the join and the window.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vigilframe.session import fresh_path, written

SEG, PARENT = "_seg", "_parent"


def newest_n(df: DataFrame, n: int, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Newest ``n`` rows, newest first: a per-task heap, never a full sort."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def newest_n_in_order(df: DataFrame, n: int, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Newest ``n`` rows, oldest first."""
    return newest_n(df, n, order).orderBy(*order)


def newest_n_per_key(df: DataFrame, keys: Sequence[str], n: int, order: str = "seq") -> DataFrame:
    """Newest ``n`` rows of each key; the rank limit also runs before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def _with_segment(df: DataFrame, order: str, width: int) -> DataFrame:
    # Whole-number division: a double can't hold numbers beyond 2^53.
    return df.withColumn(SEG, F.expr(f"cast(`{order}` as bigint) div {int(width)}"))


def lag_by_key(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, width: int = 65536
) -> DataFrame:
    """The value of the key's preceding row, NULL on its first row."""
    rows = _with_segment(df, order, width)
    group = [*keys, SEG]
    over_key = Window.partitionBy(*keys).orderBy(SEG)
    carry = (
        rows.groupBy(*group).agg(F.max_by(value, order).alias("_last"))
        .select(*group, F.lag("_last").over(over_key).alias("_carry"))
    )
    inside = Window.partitionBy(*group).orderBy(order)
    return (
        rows.join(carry, group)
        .withColumn("_n", F.row_number().over(inside))
        .withColumn(out, F.when(F.col("_n") == 1, F.col("_carry")).otherwise(F.lag(value).over(inside)))
        .drop(SEG, "_n", "_carry")
    )


def trailing_by_key(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, k: int, width: int = 65536
) -> DataFrame:
    """Array of the key's last ``k`` values up to and including each row."""
    rows = _with_segment(df, order, width)
    group = [*keys, SEG]
    newest = Window.partitionBy(*group).orderBy(F.col(order).desc())
    tails = (
        rows.select(*group, order, value)
        .withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= k)
        .groupBy(*group)
        .agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("_t"))
    )
    before = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(-k, -1)
    carry = tails.select(*group, F.flatten(F.collect_list("_t").over(before))["v"].alias("_carry"))
    inside = Window.partitionBy(*group).orderBy(order).rowsBetween(-(k - 1), 0)
    joined = F.concat(F.col("_carry"), F.collect_list(value).over(inside))
    last = F.slice(joined, F.greatest(F.lit(1), F.size(joined) - (k - 1)), F.lit(k))
    return rows.join(carry, group).withColumn(out, last).drop(SEG, "_carry")


# --- exponential decay -----------------------------------------------------------------

BLOCK = 512  # powers of two up to 2**512 stay exact in a double
REACH = 64  # rows older than this weigh less than one part in 1e19


def _decay_carry(parts: DataFrame, keys: Sequence[str], levels: int, fan: int = 4096) -> DataFrame:
    """State at the start of each segment, from (key, segment, rows, end state) summaries.

    Segments are grouped under parents of ``fan`` segments, so that not even the summaries
    of one hot key meet in one task before they are ``fan`` times fewer.
    """
    group = [*keys, PARENT] if levels else list(keys)
    parts = parts.withColumn(PARENT, F.floor(F.col(SEG) / fan))
    ordered = Window.partitionBy(*group).orderBy(SEG)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    near = ordered.rowsBetween(-REACH, -1)
    parts = (
        parts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .withColumn("_upto", F.sum("_rows").over(upto))
        .withColumn("_near", F.collect_list(F.struct("_end", "_upto")).over(near))
        .withColumn(
            "_local",
            F.aggregate(
                "_near", F.lit(0.0),
                lambda acc, p: acc + p["_end"] * F.pow(F.lit(0.5), F.col("_before") - p["_upto"]),
            ),
        )
    )
    if not levels:
        return parts.select(*keys, SEG, F.col("_local").alias("_carry"))
    # Written once: the parents are made of them, and join them.
    parts = written(parts.select(*keys, SEG, PARENT, "_rows", "_end", "_before", "_local"), "parts")
    own_end = F.col("_end") + F.col("_local") * F.pow(F.lit(0.5), F.col("_rows"))
    parents = (
        parts.groupBy(*keys, PARENT)
        .agg(F.sum("_rows").alias("_rows"), F.max_by(own_end, SEG).alias("_end"))
        .withColumnRenamed(PARENT, SEG)
    )
    above = _decay_carry(parents, keys, levels - 1, fan).select(
        *keys, F.col(SEG).alias(PARENT), F.col("_carry").alias("_above")
    )
    return parts.join(above, [*keys, PARENT]).select(
        *keys, SEG,
        (F.col("_local") + F.col("_above") * F.pow(F.lit(0.5), F.col("_before"))).alias("_carry"),
    )


def decayed_sum(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, levels: int = 1
) -> DataFrame:
    """s(n) = value(n) + s(n-1) / 2 along each key (or along the whole table when no key).

    Inside a block the state is a running sum of ``value * 2**position`` scaled back, so a
    row costs O(1). Blocks hand their end state on through :func:`_decay_carry`.
    """
    rows = _with_segment(df, order, BLOCK)
    group = [*keys, SEG]
    inside = Window.partitionBy(*group).orderBy(order)
    rows = rows.withColumn("_n", F.row_number().over(inside))
    running = F.sum(F.col(value) * F.pow(F.lit(2.0), F.col("_n"))).over(
        inside.rowsBetween(Window.unboundedPreceding, 0)
    )
    rows = rows.withColumn("_s", running * F.pow(F.lit(0.5), F.col("_n")))
    ends = rows.groupBy(*group).agg(F.max("_n").alias("_rows"), F.max_by("_s", "_n").alias("_end"))
    carry = _decay_carry(ends, keys, levels)
    return (
        rows.join(carry, group)
        .withColumn(out, F.col("_s") + F.col("_carry") * F.pow(F.lit(0.5), F.col("_n")))
        .drop(SEG, "_n", "_s", "_carry")
    )


def decayed_sum_last(df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str) -> DataFrame:
    """The newest state of :func:`decayed_sum`: only the newest rows of a key matter."""
    if keys:
        near = df.withColumn("_v", value).select(*keys, order, "_v")
        ranked = Window.partitionBy(*keys).orderBy(F.col(order).desc())
        near = near.withColumn("_r", F.row_number().over(ranked)).filter(F.col("_r") <= REACH)
    else:
        near = newest_n(df.select(F.col(order), value.alias("_v")), REACH, (order,))
        near = near.withColumn("_r", F.row_number().over(Window.orderBy(F.col(order).desc())))
    return near.groupBy(*keys).agg(
        F.sum(F.col("_v") * F.pow(F.lit(0.5), F.col("_r") - 1)).alias(out)
    )


# --- sequential acceptance ----------------------------------------------------------------

# (ordered rows, states by key, least time of any later row) -> (accepted mask, states worth keeping)
Decide = Callable[[pd.DataFrame, dict, float], tuple[list[bool], dict]]
LANE = "_lane"


def accept_in_order(
    df: DataFrame, keys: Sequence[str], order: str, decide: Decide, width: int = 65536, lanes: int = 64,
    clock: str = "ms", rounds: int = 3,
) -> DataFrame:
    """Rows a sequential rule accepts, where each decision depends on earlier acceptances.

    Keys are dealt into ``lanes`` by hash, and a lane is cut into segments of at most
    ``width`` rows, so a hot key is split like any other. A segment takes as many sequence
    numbers as that allows: its state, which holds all sources heard of late, is handed on once
    for that many rows. All segments run at once from an empty start state; then only those whose true start state (the end state of the segment
    before) turns out different run again. Rules that forget after a while settle in two or
    three rounds. Lanes that don't settle in ``rounds``, or whose time runs back by a segment
    or more so that nothing is forgotten, are read key by key in order instead. The result
    is exact in any case. States are known by the first of ``keys``.
    """
    spark = df.sparkSession
    group = [LANE, SEG]

    def written(frame: DataFrame, label: str) -> DataFrame:
        path = fresh_path(spark, label)
        frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    lane = F.pmod(F.hash(*keys), F.lit(lanes))
    base = written(_with_segment(df, order, width).withColumn(LANE, lane), "segments")
    end_schema = T.StructType([
        T.StructField(LANE, T.IntegerType()), T.StructField(SEG, T.LongType()),
        T.StructField("_start", T.StringType()), T.StructField("_end", T.StringType()),
    ])
    # A sequence number may repeat among keys, so an accepted row is known by both.
    mask_schema = T.StructType([T.StructField(f"_is_{c}", base.schema[c].dataType) for c in (*keys, order)])

    def accepted_of(rows: pd.DataFrame, mask: list[bool]) -> pd.DataFrame:
        return rows.loc[mask, [*keys, order]].set_axis(mask_schema.names, axis=1)

    def decided(rows: pd.DataFrame, known: pd.DataFrame):
        later = known["_later"].iloc[0]
        return decide(rows, json.loads(known["_start"].iloc[0]), float("inf") if pd.isna(later) else float(later))

    def finish(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        _, end = decided(pdf.sort_values(order), known)
        head = {c: [pdf[c].iloc[0]] for c in group}
        return pd.DataFrame({**head, "_start": [known["_start"].iloc[0]], "_end": [json.dumps(end, sort_keys=True)]})

    def keep(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(order)
        return accepted_of(rows, decided(rows, known)[0])

    def in_turn(batches):
        states: dict = {}
        for rows in batches:
            if len(rows):
                mask, states = decide(rows, states, float("-inf"))
                last = rows[keys[0]].iloc[-1]
                states = {k: v for k, v in states.items() if k == last}
                yield accepted_of(rows, mask)

    def per_segment(rows: DataFrame, starts: DataFrame, run, schema) -> DataFrame:
        # A state meets its segment once; joined, it would be copied to each row.
        return rows.groupBy(*group).cogroup(starts.groupBy(*group)).applyInPandas(run, schema)

    over_lane = Window.partitionBy(LANE).orderBy(SEG)
    later = F.min("_least").over(over_lane.rowsBetween(1, Window.unboundedFollowing))
    spans = written(base.groupBy(*group).agg(F.min(clock).alias("_least"), F.count("*").alias("_rows")).withColumn("_later", later), "spans")
    runs_back = F.coalesce(F.bool_or(F.col("_later") < F.col("_least")), F.lit(False))
    found = spans.groupBy(LANE).agg(runs_back.alias("back"), F.max("_rows").alias("most")).collect()  # at most one row a lane
    back, forward = ({r[LANE] for r in found if r["back"] == b} for b in (True, False))
    accepted = spark.createDataFrame([], mask_schema)
    if forward:
        fits = {r[LANE]: max(1, width // r["most"]) for r in found}
        wider = F.expr(f"{SEG} div element_at(array({', '.join(str(fits.get(n, 1)) for n in range(lanes))}), {LANE} + 1)")
        rows = base.where(F.col(LANE).isin(forward)).withColumn(SEG, wider)
        spans = spans.where(F.col(LANE).isin(forward)).withColumn(SEG, wider).groupBy(*group).agg(F.min("_least").alias("_least"))
        spans = written(spans.withColumn("_later", later).select(*group, "_later"), "spans")
        ends = written(per_segment(rows, spans.withColumn("_start", F.lit("{}")), finish, end_schema), "ends")
        for turn in range(rounds + 1):
            true_start = ends.select(
                *group, "_end", F.col("_start").alias("_used"),
                F.coalesce(F.lag("_end").over(over_lane), F.lit("{}")).alias("_start"),
            )
            stale = written(true_start.filter(F.col("_start") != F.col("_used")).select(*group, "_start"), "stale")
            unsettled = {r[LANE] for r in stale.select(LANE).distinct().collect()}
            if not unsettled or turn == rounds:
                break
            again = rows.join(stale.select(*group), group, "left_semi")
            redone = written(per_segment(again, stale.join(spans, group), finish, end_schema), "redone")
            ends = written(ends.join(redone.select(*group), group, "left_anti").unionByName(redone), "ends")
        back, forward = back | unsettled, forward - unsettled
        settled = ends.where(F.col(LANE).isin(forward)).select(*group, "_start").join(spans, group)
        accepted = per_segment(rows.where(F.col(LANE).isin(forward)), settled, keep, mask_schema)
    if back:
        rows = base.where(F.col(LANE).isin(back)).repartition(*keys).sortWithinPartitions(*keys, order)
        accepted = accepted.unionByName(rows.mapInPandas(in_turn, mask_schema))
    same = [base[c].eqNullSafe(accepted[f"_is_{c}"]) for c in (*keys, order)]
    return base.join(accepted, same, "left_semi").drop(SEG, LANE)
