"""Connected components: contraction of an edge table, finished in one task once it is small."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.words import settle

FINISH_EDGES = 1 << 20  # so few edges (16 MB) end in one task; more are contracted first


def least_members(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots): the least node of each node's component, by hooking roots and halving paths."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    parent = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return nodes, nodes[parent]


def forest(edges: DataFrame) -> DataFrame:
    """As few edges of each task's as keep what is connected so; nothing is shuffled."""
    def run(batches):
        held = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for batch in batches:
            for side, column in zip(held, batch.columns):
                side.append(column.to_numpy(zero_copy_only=False))
            if sum(map(len, held[0])) > FINISH_EDGES:
                nodes, roots = least_members(*map(np.concatenate, held))
                held = [nodes[nodes != roots]], [roots[nodes != roots]]
                if len(held[0][0]) > FINISH_EDGES // 2:  # a task keeps a bounded number of edges
                    yield rows(*held[0], *held[1])
                    held = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        nodes, roots = least_members(*map(np.concatenate, held))
        yield rows(nodes[nodes != roots], roots[nodes != roots])

    def rows(u, v):
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def finished(edges: DataFrame) -> DataFrame:
    """(node, root) of at most FINISH_EDGES edges, in one task."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, roots = least_members(pdf["u"].to_numpy(), pdf["v"].to_numpy())
        return pd.DataFrame({"node": nodes, "root": roots})

    return edges.groupBy(F.lit(0).alias("all")).applyInPandas(run, "node long, root long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is one node of its component.

    Each task first leaves out the edges that connect nothing new. While more than FINISH_EDGES
    are left, a round maps a node to the first of itself and its neighbours, in an order drawn
    anew by a hash, and renames the edges' ends: on average that leaves a constant share of the
    nodes with edges, whatever the graph's form. The first one is taken map-side before the
    shuffle; renaming is a join that adaptive execution splits.
    """
    edges = settle(forest(edges.where("u <> v")))
    maps: list[DataFrame] = []
    while edges.count() > FINISH_EDGES:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        drawn = lambda c, r=len(maps): F.xxhash64(c, F.lit(r))
        step = settle(both.groupBy("u").agg(F.min_by("v", drawn("v")).alias("first")).select(
            F.col("u").alias("node"), F.when(drawn("u") <= drawn("first"), F.col("u")).otherwise(F.col("first")).alias("parent")))
        left = step.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        right = step.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        edges = settle(forest(edges.join(left, "u").join(right, "v").where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct()))
        maps.append(step)
    last = settle(finished(edges))
    if not maps:
        return last
    roots = maps[0].select("node", F.col("parent").alias("root"))
    for step in [*maps[1:], last.withColumnRenamed("root", "parent")]:
        step = step.select(F.col("node").alias("root"), "parent")
        roots = settle(roots.join(step, "root", "left").select("node", F.coalesce("parent", "root").alias("root")))
    return roots
