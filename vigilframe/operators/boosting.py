"""Boosted trees on gradients and second derivatives, from histograms of quantile bins.

A level of a tree is one pass over the binned rows: each task adds up gradients per model, node,
feature and bin, the tasks' sums (of fixed size) are added in two rounds, and the driver picks
the splits. Leaves are -G / (H + lambda). Rows and columns are drawn per tree. Several models
on parts of the same rows, as the folds of a cross-validation, grow in the same passes.

With `squared` the trees are those of Spark's boosted classifier instead: least squares on the
residuals of its loss (the first tree: on the labels), columns drawn per node.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilframe.session import fresh_path

BINS = 128  # a bin fits a byte
MIX = np.uint64(0x9E3779B97F4A7C15)
NO_PART = -(2**31)  # rows without a part are used by all models
MASK_LEVELS = 4  # levels whose positions fit the bits of a code
LOWEST = np.array([(n & -n).bit_length() - 1 if n else 0 for n in range(1 << (1 << MASK_LEVELS))])  # lowest set bit


@dataclass(frozen=True)
class Settings:
    # The hyper-parameters of the published full model.
    trees: int = 11
    depth: int = 3
    rate: float = 0.08
    rows: float = 0.55  # share of the rows a tree is grown on
    columns: float = 0.55  # share of the features a tree may split on, rounded up
    l2: float = 6.0
    least_weight: float = 1.0  # second derivatives a child must hold
    seed: int = 42
    squared: bool = False  # Spark's trees: a row weighs 1, the first tree counts in full

    def weight(self, tree: int) -> float:
        return 1.0 if self.squared and tree == 0 else self.rate


@dataclass
class Tree:
    """A complete tree in level order: feature (-1 where nothing splits) and last bin that goes left; values of the lowest level.

    sums: what the rows of a node add up to, by its place in level order, the lowest level included.
    """

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    columns: np.ndarray
    sums: dict[int, np.ndarray] = field(default_factory=dict)

    def places(self, bins: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
        """A code of each row (bins: feature by row), and the position in the given level by code.

        Bit n of a code is set where no test sends the row away from position n to the right: the lowest
        bit is the row's position. A feature's tests are looked up together, by bin.
        """
        if levels > MASK_LEVELS:
            return self.walk(bins, levels), np.arange(1 << levels)
        width = 1 << levels
        kind = np.uint8 if width <= 8 else np.uint16
        left_open: dict[int, np.ndarray] = {}
        for level in range(levels):
            for n in range(1 << level):
                node, span = (1 << level) - 1 + n, width >> (level + 1)
                f = int(self.feature[node])
                if f >= 0:
                    table = left_open.setdefault(f, np.full(BINS, (1 << width) - 1, kind))
                    table[self.cut[node] + 1:] &= kind(((1 << width) - 1) ^ (((1 << span) - 1) << (2 * n * span)))
        codes = np.full(bins.shape[1], (1 << width) - 1, kind)
        for f, table in left_open.items():
            codes &= table.take(bins[f])
        return codes, LOWEST[: 1 << width]

    def walk(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Position in the given level of each row, test by test; for trees too deep for codes."""
        at = np.zeros(bins.shape[1], np.int64)
        for level in range(levels):
            node = (1 << level) - 1 + at
            f = self.feature[node]
            at = 2 * at + ((f >= 0) & (bins[np.maximum(f, 0), np.arange(len(at))] > self.cut[node]))
        return at


@dataclass
class Booster:
    features: list[str]
    edges: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)

    def margin(self) -> Column:
        """The sum of the leaves as one expression; a missing value goes left."""
        total = F.lit(0.0)
        for tree in self.trees:
            total = total + self.branch(tree, 0, 0)
        return total

    def branch(self, tree: Tree, node: int, level: int) -> Column:
        first = len(tree.feature)
        if node >= first:
            return F.lit(float(tree.value[node - first]))
        f = int(tree.feature[node])
        if f < 0:
            return self.branch(tree, 2 * node + 1, level + 1)
        x = F.col(f"`{self.features[f]}`").cast("double")
        left = x.isNull() | F.isnan(x) | (x <= float(self.edges[f][tree.cut[node]]))
        return F.when(left, self.branch(tree, 2 * node + 1, level + 1)).otherwise(self.branch(tree, 2 * node + 2, level + 1))


def bin_edges(rows: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Upper ends of all bins but the last, from approximate quantiles; one pass for all features."""
    shares = [i / BINS for i in range(1, BINS)]
    clean = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
    found = rows.agg(*[F.percentile_approx(clean(c), shares, 10_000).alias(f"q{n}") for n, c in enumerate(features)]).first()
    return [np.unique(np.array(q if q is not None else [], float)) for q in found]


def middle_edges(rows: DataFrame, features: Sequence[str], bins: int, points: int = 4096) -> list[np.ndarray]:
    """Thresholds as Spark's trees have them: midway between neighbouring values, all of them where they are few, else at even shares.

    Spark takes the values of a sample of 10 000 rows; here they are approximate quantiles of all rows.
    """
    shares = F.lit(np.arange(points + 1) / points)  # one literal: a column for each share takes longer to build than the query
    clean = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
    found = rows.agg(*[F.percentile_approx(clean(c), shares, 10_000).alias(f"q{n}") for n, c in enumerate(features)]).first()
    return [thresholds(*np.unique(np.array(q if q is not None else [], float), return_counts=True), bins) for q in found]


def thresholds(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """At most bins - 1 midpoints of neighbouring values, those nearest to even shares of the counts."""
    middles = (values[:-1] + values[1:]) / 2
    if len(middles) < bins:
        return middles
    upto, stride, cuts = counts.cumsum(), counts.sum() / bins, []
    for n, middle in enumerate(middles):
        target = stride * (len(cuts) + 1)
        if abs(upto[n] - target) < abs(upto[n + 1] - target):
            cuts.append(middle)
    return np.array(cuts)


BLOCKS = "bins binary, label binary, h binary, part binary"


def binned(rows: DataFrame, features: Sequence[str], edges: list[np.ndarray], label: str, key: Sequence[str], part: Column,
           files: int | None = None) -> DataFrame:
    """Blocks of rows: bins of the features as bytes, the labels, hashes that draw the rows, and their parts; written once.

    A block is one row here, since handing each row of each pass to Python by itself costs more than the pass.
    Without a key each row is drawn by itself. With `files` the blocks are dealt out to so many.
    """
    def run(batches):
        for batch in batches:
            bins = np.empty((len(edges), batch.num_rows), np.int8)
            for n, cuts in enumerate(edges):
                x = batch.column(n).to_numpy(zero_copy_only=False).astype(float)
                bins[n] = np.where(np.isnan(x), 0, np.searchsorted(cuts, x, side="left"))
            y, h, of = (batch.column(len(edges) + n).to_numpy(zero_copy_only=False) for n in range(3))
            held = bins, y.astype(np.int32), h.astype(np.int64), of.astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in held], names=["bins", "label", "h", "part"])

    kept = rows.select(*[F.col(f"`{c}`").cast("double").alias(f"x{n}") for n, c in enumerate(features)],
                       F.col(label).cast("int").alias("label"), F.xxhash64(*key or [F.monotonically_increasing_id()]).alias("h"), F.coalesce(part.cast("int"), F.lit(NO_PART)).alias("part"))
    path = fresh_path(rows.sparkSession, "binned")
    blocks = kept.where("label is not null").mapInArrow(run, BLOCKS)
    (blocks.repartition(files) if files else blocks).write.parquet(path)
    return rows.sparkSession.read.schema(T._parse_datatype_string(BLOCKS)).parquet(path)


def blocks_of(batches: Iterable[pa.RecordBatch], features: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """bins (feature by row), labels, hashes and parts of each block."""
    for batch in batches:
        for n in range(batch.num_rows):
            bins, y, h, part = (np.frombuffer(batch.column(c)[n].as_py(), kind) for c, kind in enumerate((np.int8, np.int32, np.int64, np.int32)))
            yield bins.reshape(features, -1), y, h, part


def drawn(h: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    x = (h.view(np.uint64) + np.uint64(((tree + 1) * int(MIX) + seed) % 2**64)) * MIX
    x ^= x >> np.uint64(32)
    x *= MIX
    return (x >> np.uint64(11)).astype(float) < share * 2.0**53


def margin_of(bins: np.ndarray, trees: list[Tree]) -> np.ndarray:
    margin = np.zeros(bins.shape[1])
    for tree in trees:
        codes, place = tree.places(bins, len(tree.value).bit_length() - 1)
        margin += tree.value[place].take(codes)
    return margin


def gradients(bins: np.ndarray, y: np.ndarray, trees: list[Tree], squared: bool) -> tuple[np.ndarray, ...]:
    """First and second derivative of each row's loss; with `squared` its residual with opposite sign, 1, and the residual's square."""
    margin = margin_of(bins, trees)
    if not squared:
        p = 1 / (1 + np.exp(-margin))
        return p - y, p * (1 - p)
    sign = 2.0 * y - 1
    rest = 4 * sign / (1 + np.exp(2 * sign * margin)) if trees else sign
    return -rest, np.ones(len(y)), rest * rest


def histogram(bins: np.ndarray, y: np.ndarray, use: np.ndarray, trees: list[Tree], growing: Tree, level: int, squared: bool = False) -> np.ndarray:
    """Sums of gradients and second derivatives of the rows in use: node, feature, bin, which."""
    weights = [np.where(use, w, 0.0) for w in gradients(bins, y, trees, squared)]
    codes, place = growing.places(bins, level)
    first, count = (place * BINS).take(codes), len(bins)
    out = np.zeros((1 << level, count, BINS, len(weights)))
    for f in growing.columns:
        spot = first + bins[f]
        for which, weight in enumerate(weights):
            out[:, f, :, which] = np.bincount(spot, weight, minlength=(1 << level) * BINS).reshape(-1, BINS)
    return out


def summed(rows: DataFrame, size: int, tasks: int) -> np.ndarray:
    """Adds the tasks' sums, 64 at a time, until at most 64 rows of that size are left for the driver."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"task": pdf["task"].iloc[:1], "sums": [total(zip(pdf["task"], pdf["sums"])).tobytes()]})

    def total(held) -> np.ndarray:
        out = np.zeros(size)
        for _, data in sorted(held):  # floats are added in a settled order
            out += np.frombuffer(data)
        return out

    while tasks > 64:
        rows = rows.groupBy(F.floor(F.col("task") / 64).alias("lane")).applyInPandas(add, "task long, sums binary").withColumn(
            "task", F.floor(F.col("task") / 64))
        tasks = -(-tasks // 64)
    return total((r["task"], bytes(r["sums"])) for r in rows.collect())


def best_splits(hist: np.ndarray, columns: Sequence[np.ndarray], edges: list[np.ndarray], settings: Settings, counted: int):
    """(feature, cut, sums left, sums right) of each node, on the node's columns; `counted` is a column in the sums; feature -1 where no split gains, all going left."""
    for node, columns in zip(hist, columns):
        whole = node[counted].sum(axis=0)
        best = (0.0, -1, 0, whole, np.zeros(len(whole)))
        score = lambda s: s[..., 0] ** 2 / np.maximum(s[..., 1] + settings.l2, 1e-300)
        for f in columns:
            left = node[f].cumsum(axis=0)[: len(edges[f])]
            right = whole - left
            gain = score(left) + score(right) - score(whole)
            gain[(left[:, 1] < settings.least_weight) | (right[:, 1] < settings.least_weight)] = 0.0
            if len(gain) and gain.max() > best[0] + 1e-12:
                at = int(gain.argmax())
                best = (float(gain[at]), int(f), at, left[at], right[at])
        yield best[1:]


def columns_of(tree: int, features: int, settings: Settings, node: int | None = None) -> np.ndarray:
    chosen = np.random.default_rng([settings.seed, tree, *([] if node is None else [node])]).choice(features, max(1, math.ceil(settings.columns * features)), replace=False)
    return np.sort(chosen)


def train(rows: DataFrame, features: Sequence[str], label: str = "label", key: Sequence[str] = ("flow_key",), settings: Settings = Settings(),
          part: Column | None = None, parts: Sequence[int] = (-1,)) -> list[Booster]:
    """A model for each of `parts`, on the rows whose `part` differs from it; without parts one model on all rows.

    Rows without a label are left out; missing feature values lie in the first bin. Rows that
    repeat a key are drawn together.
    """
    edges = bin_edges(rows, features)
    return grown(binned(rows, features, edges, label, key, F.lit(0) if part is None else part), features, edges, settings, parts)


def grown(data: DataFrame, features: Sequence[str], edges: list[np.ndarray], settings: Settings, parts: Sequence[int]) -> list[Booster]:
    """The models of :func:`train` on binned rows."""
    models, tasks = [Booster(list(features), edges) for _ in parts], data.rdd.getNumPartitions()
    leaves, inner = 1 << settings.depth, (1 << settings.depth) - 1
    for tree in range(settings.trees):
        columns, none = columns_of(tree, len(features), settings), np.array([], int)
        growing = [Tree(np.full(inner, -1), np.zeros(inner, np.int64), np.zeros(leaves), columns) for _ in parts]
        for level in range(settings.depth):
            nodes = range((1 << level) - 1, (2 << level) - 1)
            drawn_for = [columns_of(tree, len(features), settings, at) if settings.squared else columns for at in nodes]
            for grown in growing:
                grown.columns = np.unique(np.concatenate(drawn_for))
            hists = level_sums(data, models, growing, level, tree, list(parts), settings, tasks)
            if tree == level == 0 and not hists.any():
                raise ValueError("no rows to train on")
            for grown, hist in zip(growing, hists):
                # What didn't split stays whole, whichever columns are drawn further down.
                open_to = [of if level == 0 or grown.feature[(at - 1) // 2] >= 0 else none for at, of in zip(nodes, drawn_for)]
                for n, (at, (f, cut, left, right)) in enumerate(zip(nodes, best_splits(hist, open_to, edges, settings, int(grown.columns[0])))):
                    grown.feature[at], grown.cut[at] = f, cut
                    grown.sums[at] = left + right
                    if level == settings.depth - 1:
                        for side, sums in enumerate((left, right)):
                            weight = sums[1] + settings.l2
                            grown.sums[2 * at + 1 + side] = sums
                            grown.value[2 * n + side] = -settings.weight(tree) * sums[0] / weight if weight > 0 else 0.0
        for model, grown in zip(models, growing):
            model.trees.append(grown)
    return models


def level_sums(data: DataFrame, models: list[Booster], growing: list[Tree], level: int, tree: int, parts: list[int], settings: Settings, tasks: int) -> np.ndarray:
    known, features = [m.trees for m in models], len(models[0].features)
    shape = (len(models), 1 << level, features, BINS, 3 if settings.squared else 2)

    def run(batches):
        total = np.zeros(shape)
        for bins, y, h, part in blocks_of(batches, features):
            chosen = np.flatnonzero(drawn(h, tree, settings.seed, settings.rows))
            bins, y, part = bins.take(chosen, axis=1).astype(np.int64), y[chosen], part[chosen]
            for m in range(len(known)):
                total[m] += histogram(bins, y, part != parts[m], known[m], growing[m], level, settings.squared)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["task", "sums"])

    return summed(data.mapInArrow(run, "task long, sums binary"), int(np.prod(shape)), tasks).reshape(shape)


def score(model: Booster, rows: DataFrame) -> DataFrame:
    """Adds score, the probability of an attack, and prediction (0/1)."""
    return with_score(rows, model.margin())


def with_score(rows: DataFrame, margin: Column) -> DataFrame:
    return rows.withColumn("score", 1 / (1 + F.exp(-margin))).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))


def cross_scored(rows: DataFrame, features: Sequence[str], fold: str, k: int, key: Sequence[str], settings: Settings = Settings()) -> DataFrame:
    """(fold, label, score, prediction) of each labelled row, by the model that was grown without its fold.

    All models grow in the same passes; rows are scored by their bins, which tell the same as the values.
    """
    edges = bin_edges(rows, features)
    data = binned(rows, features, edges, "label", key, F.col(fold))
    models = grown(data, features, edges, settings, range(k))

    def run(batches):
        for bins, y, _, part in blocks_of(batches, len(features)):
            margin = np.full(len(y), np.nan)
            for n, model in enumerate(models):
                here = np.flatnonzero(part == n)
                margin[here] = margin_of(bins.take(here, axis=1).astype(np.int64), model.trees)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(y), pa.array(margin)], names=[fold, "label", "margin"])

    scored = data.mapInArrow(run, f"`{fold}` int, label int, margin double")
    return with_score(scored.where(F.col(fold).between(0, k - 1)), F.col("margin")).drop("margin")
