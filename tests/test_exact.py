"""Exact order statistics, splits and quality figures against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilframe.operators import distribution, evaluation, exact

PS = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)


def columns():
    rng = np.random.default_rng(1)
    yield "normal", rng.normal(64, 12, 4000)
    yield "one value holds a third", np.concatenate([np.full(1500, 7.0), rng.exponential(9, 2500)])
    yield "constant", np.full(50, 3.5)
    yield "single", np.array([2.0])
    yield "two", np.array([1.0, 9.0])


@pytest.mark.parametrize("name,values", list(columns()))
@pytest.mark.parametrize("accuracy", [200, 100_000])
def test_percentiles(spark, name, values, accuracy):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
    stats = exact.order_statistics(df, "x", PS, accuracy)
    got = {r["p"]: r["v"] for r in stats.select("p", exact.interpolate(F.col("n"), F.col("p"), F.col("lo_v"), F.col("hi_v")).alias("v")).collect()}
    for p in PS:
        assert got[p] == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_distribution(spark):
    values = np.random.default_rng(2).normal(64, 12, 512)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    low, high = np.quantile(values, 0.01), np.quantile(values, 0.99)
    clipped = values.clip(low, high)
    counts, edges = np.histogram(clipped, bins=min(30, max(10, int(len(clipped) ** 0.5))))
    rows = distribution.histogram(df, "x").orderBy("bin").collect()
    assert [r["count"] for r in rows] == counts.tolist()
    assert [r["edge"] for r in rows] == pytest.approx(edges[:-1].tolist())
    one = distribution.bounds_and_percentiles(df, "x").first()
    assert one["p25"] == pytest.approx(np.quantile(clipped, 0.25))
    m = distribution.moments(df, "x").first()
    assert m["std"] == pytest.approx(clipped.std(ddof=1)) and m["mean"] == pytest.approx(clipped.mean())


def test_constant_column_histogram(spark):
    rows = distribution.histogram(spark.createDataFrame([(4.0,)] * 30, "x double"), "x").orderBy("bin").collect()
    assert len(rows) == 10 and sum(r["count"] for r in rows) == 30 and rows[0]["edge"] == 3.5


def test_hash_slots(spark):
    rng = random.Random(4)
    rows = [(f"r{i}", "big" if rng.random() < 0.8 else "small") for i in range(2000)]
    df = spark.createDataFrame(rows, "id string, c string")
    folds = exact.stratified_folds(df, "c", ["id"], 5)
    want = {}
    for c in ("big", "small"):
        ids = sorted((hashlib.md5(f"42|{i}".encode()).hexdigest(), i) for i, k in rows if k == c)
        cuts = [len(ids) * j // 5 for j in range(1, 5)]
        for rank, (_, i) in enumerate(ids):
            want[i] = sum(cut <= rank for cut in cuts)
    assert {r["id"]: r["fold"] for r in folds.collect()} == want
    part = exact.stratified_split(df, "c", ["id"]).groupBy("c", "part").count().collect()
    sizes = {(r["c"], r["part"]): r["count"] for r in part}
    for c in ("big", "small"):
        n = sum(k == c for _, k in rows)
        assert sizes[c, "train"] == round(n * 0.8)


def test_sample_is_exact_even_with_few_cells(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("f"))
    slots = exact.hash_slots(df, ["f"], ["id"], lambda n: F.array(F.floor(n / 2)), cell_digits=1)
    assert slots.count() == 1000
    assert {r["f"]: r["n"] for r in slots.filter("slot = 0").groupBy("f").agg(F.count("*").alias("n")).collect()} == {0: 167, 1: 166, 2: 166}


@pytest.mark.parametrize("digits", [1, 6])
def test_auc(spark, digits):
    rng = random.Random(6)
    rows = [(int(rng.random() < 0.4), round(rng.random(), digits)) for _ in range(400)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    got = evaluation.auc_roc(spark.createDataFrame(rows, "label int, score double")).first()["auc"]
    assert got == pytest.approx(want, abs=1e-12)


def test_report_and_matrix(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "label int, prediction int")
    cells = {(r["label"], r["prediction"]): r["n"] for r in evaluation.confusion_matrix(df).collect()}
    assert cells == {(0, 0): 2, (0, 1): 0, (1, 0): 1, (1, 1): 1}
    rep = {r["class"]: r for r in evaluation.classification_report(df).collect()}
    assert rep["1"]["recall"] == 0.5 and rep["1"]["precision"] == 1.0 and rep["macro avg"]["support"] == 4


def test_rows_of_cells_without_a_cut_stay_where_they_are(spark):
    """Only the rows of the cells a cut runs through are sent: the others lie in the partitions they came in."""
    df = spark.range(4000, numPartitions=4).selectExpr("id", "id % 2 AS cls").withColumn("was", F.spark_partition_id())
    split = exact.stratified_split(df, "cls", ["id"]).withColumn("now", F.spark_partition_id())
    rows = split.collect()
    assert sum(r["now"] != r["was"] for r in rows) < 20
    for cls in (0, 1):
        first = sorted(range(cls, 4000, 2), key=lambda n: hashlib.md5(f"42|{n}".encode()).hexdigest())[:1600]
        assert {r["id"] for r in rows if r["cls"] == cls and r["part"] == "train"} == set(first)
