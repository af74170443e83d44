"""Shapley contributions of boosted trees, looked up for whole batches of rows.

For one leaf, let A be the set of path tests a row passes and B those a background row
passes. The game "does the leaf receive the mixed row" has a closed form: tests only the
row passes gain, tests only the background passes lose, with weights that depend on the
two counts alone. Averaging over the background needs only how often each B occurs, one
grouped pass. What is left per row is a table look-up by A, a map-only projection: rows
are never joined with leaves or with background rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field
from math import factorial, inf

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.session import fresh_path


@dataclass
class Leaf:
    tree: int
    leaf: int
    value: float
    # feature index -> (exclusive lower, inclusive upper) bound on the path
    box: dict[int, tuple[float, float]] = field(default_factory=dict)


def leaf_boxes(spark: SparkSession, model: PipelineModel) -> list[Leaf]:
    """Leaves of the trained trees as boxes, read from the model's saved node table.

    The number of leaves is bounded by trees * 2**depth; nothing here grows with the data.
    """
    ensemble = model.stages[-1]
    path = fresh_path(spark, "trees")
    ensemble.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    weights = list(ensemble.treeWeights)
    by_tree: dict[int, dict[int, object]] = defaultdict(dict)
    for row in nodes.collect():
        by_tree[row["treeID"]][row["nodeData"]["id"]] = row["nodeData"]
    leaves: list[Leaf] = []
    for tree, table in sorted(by_tree.items()):
        stack, order = [(0, {})], 0
        while stack:
            node_id, box = stack.pop()
            node = table[node_id]
            if node["leftChild"] < 0:
                leaves.append(Leaf(tree, order, node["prediction"] * weights[tree], box))
                order += 1
                continue
            index, at = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
            low, high = box.get(index, (-inf, inf))
            stack.append((node["rightChild"], {**box, index: (max(low, at), high)}))
            stack.append((node["leftChild"], {**box, index: (low, min(high, at))}))
    return leaves


MASKS = "_masks"


def mask_sql(leaf: Leaf, features: Sequence[str]) -> str:
    """SQL of the mask: bit i is set when the row passes the leaf's i-th test.

    Written as SQL text, since building thousands of column objects one call at a time
    takes longer than the query.
    """
    bits = []
    for bit, (index, (low, high)) in enumerate(sorted(leaf.box.items())):
        name = f"`{features[index]}`"
        tests = [f"{name} > {low!r}D"] if low > -inf else []
        tests += [f"{name} <= {high!r}D"] if high < inf else []
        bits.append(f"IF({' AND '.join(tests)}, {1 << bit}, 0)")
    return " + ".join(bits) or "0"


def with_masks(rows: DataFrame, leaves: Sequence[Leaf], features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Evaluates every path test once per row, as one array of masks in leaf order."""
    masks = ", ".join(mask_sql(leaf, features) for leaf in leaves)
    return rows.select(*keep, F.expr(f"array({masks})").alias(MASKS))


def background_masks(background: DataFrame, leaves: Sequence[Leaf], features: Sequence[str]) -> list[dict[int, float]]:
    """How often each mask occurs per leaf, as a share of the background rows."""
    masks = with_masks(background, leaves, features)
    counts = masks.select(F.posexplode(MASKS).alias("leaf", "mask")).groupBy("leaf", "mask").agg(F.count("*").alias("n")).collect()
    totals: dict[int, int] = defaultdict(int)
    for row in counts:
        totals[row["leaf"]] += row["n"]
    shares: list[dict[int, float]] = [{} for _ in leaves]
    for row in counts:
        shares[row["leaf"]][row["mask"]] = row["n"] / totals[row["leaf"]]
    return shares


def _gain(row_mask: int, back_mask: int, bit: int) -> float:
    """Shapley value of one test in the game of a leaf and one background mask."""
    only_row = bin(row_mask & ~back_mask).count("1")
    only_back = bin(back_mask & ~row_mask).count("1")
    size = 1 << bit
    if row_mask & size and not back_mask & size:
        return factorial(only_row - 1) * factorial(only_back) / factorial(only_row + only_back)
    if back_mask & size and not row_mask & size:
        return -factorial(only_row) * factorial(only_back - 1) / factorial(only_row + only_back)
    return 0.0


def _reachable(row_mask: int, back_mask: int, tests: int) -> bool:
    """Some mixture of row and background passes all tests."""
    return (row_mask | back_mask) == (1 << tests) - 1


def contributions(leaves: Sequence[Leaf], shares: Sequence[dict[int, float]]) -> tuple[list[dict[int, np.ndarray]], float]:
    """Per leaf the contribution of each of its features by row mask, and the base value."""
    tables, base = [], 0.0
    for leaf, share in zip(leaves, shares):
        tests = len(leaf.box)
        base += leaf.value * share.get((1 << tests) - 1, 0.0)
        tables.append({
            index: np.array([
                leaf.value * sum(p * _gain(row, back, bit) for back, p in share.items() if _reachable(row, back, tests))
                for row in range(1 << tests)
            ], float)
            for bit, index in enumerate(sorted(leaf.box))
        })
    return tables, base


def attributed(leaves: Sequence[Leaf], tables: Sequence[dict[int, np.ndarray]], values: list[np.ndarray], known: list[np.ndarray]) -> list[np.ndarray]:
    """Contributions of all features, then the margin, of a batch of rows. NaN lies above all numbers, NULL passes no test."""
    out = [np.zeros(len(values[0])) for _ in range(len(values) + 1)]
    for leaf, table in zip(leaves, tables):
        mask = np.zeros(len(values[0]), np.int64)
        for bit, (index, (low, high)) in enumerate(sorted(leaf.box.items())):
            passed = known[index]
            if low > -inf:
                passed = passed & ~(values[index] <= low)
            if high < inf:
                passed = passed & (values[index] <= high)
            mask |= passed.astype(np.int64) << bit
        for index, by_mask in table.items():
            out[index] += by_mask[mask]
        out[-1] += np.where(mask == (1 << len(leaf.box)) - 1, leaf.value, 0.0)
    return out


def explain_wide(rows: DataFrame, background: DataFrame, model: PipelineModel, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Contribution columns next to base value, margin and probability of every row."""
    leaves = leaf_boxes(rows.sparkSession, model)
    tables, base = contributions(leaves, background_masks(background, leaves, features))
    names = [f"phi_{n}" for n in range(len(features))]

    @F.arrow_udf(", ".join(f"{n} double" for n in [*names, "margin"]))
    def attribute(*columns: pa.Array) -> pa.Array:
        known = [c.is_valid().to_numpy(zero_copy_only=False) for c in columns]
        values = [c.to_numpy(zero_copy_only=False).astype(float) for c in columns]
        return pa.StructArray.from_arrays([pa.array(x) for x in attributed(leaves, tables, values, known)], [*names, "margin"])

    found = rows.select(*keep, attribute(*[F.col(f"`{f}`").cast("double") for f in features]).alias("_found"))
    margin = F.col("_found.margin")
    return found.select(
        *keep, *[F.col(f"_found.phi_{n}").alias(f"phi_{f}") for n, f in enumerate(features)], F.lit(base).alias("base_value"),
        margin.alias("margin"), (1 / (1 + F.exp(margin * -2))).alias("predicted_score"),
    )


def explain_rows(rows: DataFrame, background: DataFrame, model: PipelineModel, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Long form: one row per (key, feature) with its contribution."""
    wide = explain_wide(rows, background, model, features, keep)
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"phi_{f}").alias("value")) for f in features])
    return wide.select(*keep, "base_value", "margin", "predicted_score", F.inline(pairs))


def leaf_membership(rows: DataFrame, model: PipelineModel, keep: Sequence[str]) -> DataFrame:
    """(row, tree, leaf index) of every tree, from the model's own leaf output."""
    from pyspark.ml.functions import vector_to_array

    assembler, ensemble = model.stages
    scored = ensemble.copy().setLeafCol("_leaves").transform(assembler.transform(rows))
    return scored.select(*keep, F.posexplode(vector_to_array("_leaves")).alias("tree", "leaf")).withColumn("leaf", F.col("leaf").cast("int"))


def leaf_margins(rows: DataFrame, model: PipelineModel, keep: Sequence[str]) -> DataFrame:
    """Margin of every row, summed over its leaves: the leaf table, as lists by tree, joins each row once.

    Rows are neither repeated for each tree nor sent anywhere; the lists hold at most trees * 2**depth values.
    """
    from pyspark.ml.functions import vector_to_array

    assembler, ensemble = model.stages
    scored = ensemble.copy().setLeafCol("_leaves").transform(assembler.transform(rows)).select(*keep, vector_to_array("_leaves").alias("_leaves"))
    listed = lambda by, value: F.sort_array(F.collect_list(F.struct(by, value)))[value].alias(value)
    values = leaf_values(rows.sparkSession, leaf_boxes(rows.sparkSession, model))
    values = values.groupBy("tree").agg(listed("leaf", "value")).agg(listed("tree", "value"))
    found = F.zip_with("_leaves", "value", lambda leaf, of: of[leaf.cast("int")])
    return scored.crossJoin(F.broadcast(values)).select(*keep, F.aggregate(found, F.lit(0.0), lambda total, x: total + x).alias("margin"))


def leaf_values(spark: SparkSession, leaves: Sequence[Leaf]) -> DataFrame:
    return spark.createDataFrame([(x.tree, x.leaf, float(x.value)) for x in leaves], "tree int, leaf int, value double")


def mean_abs_attribution(long: DataFrame) -> DataFrame:
    return long.groupBy(F.col("feature").alias("name")).agg(F.avg(F.abs("value")).alias("score"))
