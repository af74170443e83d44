"""Boosted trees against a plain implementation, folds grown together against folds grown alone."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from vigilframe.operators import boosting, evaluation, models

FEATURES = ["a", "b", "c", "d"]
SETTINGS = boosting.Settings(trees=4, rate=0.3)


@pytest.fixture(scope="module")
def rows(spark):
    x = lambda m, n: ((F.col("id") * m) % n).cast("double")
    df = spark.range(1000).select(
        F.col("id").alias("k"), x(7, 101).alias("a"), F.when(F.col("id") % 10 > 0, x(13, 977)).alias("b"), x(29, 5).alias("c"), x(31, 83).alias("d"))
    hit = (F.col("a") > 50) & (F.coalesce("b", F.lit(0.0)) < 600) | (F.col("c") == 3)
    return df.withColumn("label", hit.cast("int")).repartition(5).cache()


def plain(data, edges, settings, hashes, keep):
    """The same trees from their definition: every split of every node tried on the rows themselves."""
    x, y = data[FEATURES].to_numpy(), data["label"].to_numpy()
    x = np.where(np.isnan(x), -np.inf, x)
    margin = np.zeros(len(y))
    for t in range(settings.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        use = keep & boosting.drawn(hashes, t, settings.seed, settings.rows)
        leaf = np.zeros(len(y))

        def grow(inside, depth):
            def value(side):
                chosen = side & use
                return -settings.rate * g[chosen].sum() / (h[chosen].sum() + settings.l2)

            def worth(side):
                chosen = side & use
                return g[chosen].sum() ** 2 / (h[chosen].sum() + settings.l2)

            best = (0.0, None)
            for f in boosting.columns_of(t, len(FEATURES), settings):
                for cut in edges[f]:
                    left, right = inside & (x[:, f] <= cut), inside & (x[:, f] > cut)
                    if min(h[left & use].sum(), h[right & use].sum()) < settings.least_weight:
                        continue
                    gain = worth(left) + worth(right) - worth(inside)
                    if gain > best[0] + 1e-9:
                        best = (gain, left, right)
            if best[1] is None:
                leaf[inside] = value(inside)
                return
            for side in best[1:]:
                if depth + 1 == settings.depth:
                    leaf[side] = value(side)
                else:
                    grow(side, depth + 1)

        grow(np.ones(len(y), bool), 0)
        margin += leaf
    return margin


def margins(model, rows):
    return np.array([r["m"] for r in rows.withColumn("m", model.margin()).orderBy("k").collect()])


@pytest.mark.parametrize("settings", [SETTINGS, boosting.Settings(trees=3, depth=2, rows=1.0, columns=1.0, l2=1.0, rate=0.5)])
def test_trees_equal_the_plain_ones(rows, settings):
    model = boosting.train(rows, FEATURES, key=["k"], settings=settings)[0]
    data = rows.withColumn("h", F.xxhash64("k")).orderBy("k").toPandas()
    want = plain(data, model.edges, settings, data["h"].to_numpy(), np.ones(len(data), bool))
    assert np.ptp(want) > 0.3 and margins(model, rows) == pytest.approx(want, abs=1e-9)


def test_folds_grow_as_they_would_alone(rows):
    fold = (F.col("k") % 3).alias("fold")
    together = boosting.train(rows, FEATURES, key=["k"], settings=SETTINGS, part=fold, parts=range(3))
    data = rows.withColumn("h", F.xxhash64("k")).orderBy("k").toPandas()
    for n, model in enumerate(together):
        keep = (data["k"] % 3 != n).to_numpy()
        assert margins(model, rows) == pytest.approx(plain(data, model.edges, SETTINGS, data["h"].to_numpy(), keep), abs=1e-9)


def test_quality_and_penalty(rows):
    strong = boosting.Settings(trees=20, rate=0.3, l2=1.0)
    q = models.evaluate_holdout(boosting.score(boosting.train(rows, FEATURES, key=["k"], settings=strong)[0], rows)).first()
    assert q["accuracy"] > 0.9 and q["auc_roc"] > 0.95
    size = lambda l2: max(np.abs(t.value).max() for t in boosting.train(rows, FEATURES, key=["k"], settings=boosting.Settings(trees=2, l2=l2))[0].trees)
    assert size(100.0) < size(1.0)


def test_odd_rows(spark, rows):
    with pytest.raises(ValueError, match="no rows"):
        boosting.train(rows.limit(0), FEATURES, key=["k"], settings=SETTINGS)
    one_class = rows.withColumn("label", F.lit(1)).withColumn("a", F.lit(None).cast("double")).withColumn("d", F.lit(float("nan")))
    scores = boosting.score(boosting.train(one_class, FEATURES, key=["k"], settings=SETTINGS)[0], one_class)
    assert scores.where("score > 0.5 and prediction = 1").count() == 1000


def test_sums_of_many_tasks(spark):
    rows = spark.createDataFrame([(t, np.array([t, 0.5]).tobytes()) for t in range(200)], "task long, sums binary")
    assert boosting.summed(rows, 2, 200).tolist() == [199 * 100.0, 100.0]


def test_cross_validation(rows):
    folds = models.cross_validate(rows, FEATURES, ["k"], k=4).orderBy("fold").collect()
    assert [r["fold"] for r in folds] == [0, 1, 2, 3] and all(0.5 < r["accuracy"] <= 1 and 0.5 < r["auc_roc"] <= 1 for r in folds)
    summary = evaluation.cv_summary(rows.sparkSession.createDataFrame(folds), ["accuracy", "auc_roc"]).first()
    assert summary["accuracy_mean"] == pytest.approx(np.mean([r["accuracy"] for r in folds]))


def test_passes_read_blocks_of_rows(rows):
    edges = boosting.bin_edges(rows, FEATURES)
    data = boosting.binned(rows, FEATURES, edges, "label", ["k"], F.col("k") % 3)
    blocks = data.collect()
    assert len(blocks) == 5 and sum(len(b["bins"]) for b in blocks) == 1000 * len(FEATURES)
    assert sorted(h for b in blocks for h in np.frombuffer(b["h"], np.int64)) == sorted(r["h"] for r in rows.select(F.xxhash64("k").alias("h")).collect())


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 5])
def test_places_by_codes_are_those_of_the_tests(depth):
    draw, inner = np.random.default_rng(depth), (1 << depth) - 1
    bins = draw.integers(0, boosting.BINS, (4, 500))
    for _ in range(20):
        tree = boosting.Tree(draw.integers(-1, 4, inner), draw.integers(0, boosting.BINS, inner), draw.normal(size=1 << depth), np.arange(4))
        for levels in range(depth + 1):
            codes, place = tree.places(bins, levels)
            assert (place[codes] == tree.walk(bins, levels)).all()


def test_folds_are_scored_by_the_models_without_them(rows):
    folded = rows.withColumn("fold", (F.col("k") % 3).cast("int"))
    by_part = boosting.train(folded, FEATURES, key=["k"], settings=SETTINGS, part=F.col("fold"), parts=range(3))
    want = [r for n, model in enumerate(by_part) for r in boosting.score(model, folded.where(F.col("fold") == n)).select("fold", "label", "score", "prediction").collect()]
    got = boosting.cross_scored(folded, FEATURES, "fold", 3, ["k"], SETTINGS).select("fold", "label", "score", "prediction").collect()
    assert sorted(got) == sorted(want)


@pytest.fixture(scope="module")
def coarse(spark):
    """Features of few values, so that all their thresholds are tried."""
    x = lambda m, n: ((F.col("id") * m) % n).cast("double")
    df = spark.range(3000).select(
        F.col("id").alias("k"), x(7, 29).alias("a"), x(13, 23).alias("b"), x(29, 5).alias("c"), x(31, 19).alias("d"))
    hit = (F.col("a") > 15) & (F.col("b") < 12) | (F.col("c") == 3) & (F.col("d") > 4)
    return df.withColumn("label", (hit != (F.xxhash64("k") % 9 == 0)).cast("int")).repartition(5).cache()


def shape(model):
    """Features, thresholds, gains and leaves of all trees, in order, and the trees' weights."""
    def of(node):
        if "LeafNode" in node.getClass().getName():
            return [node.prediction()]
        split = node.split()
        return [split.featureIndex(), split.threshold(), node.gain(), node.impurity(), *of(node.leftChild()), *of(node.rightChild())]

    last = model.stages[-1]
    return list(last.treeWeights), [of(t._call_java("rootNode")) for t in last.trees]


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_full_model_has_the_trees_of_spark(coarse, depth):
    """With all rows and columns used, nothing is drawn: the model is that of Spark's own fit."""
    whole = {"maxIter": 4, "maxDepth": depth, "subsamplingRate": 1.0, "featureSubsetStrategy": "all", "stepSize": 0.3}
    got = models.train_full_model(coarse, FEATURES, **whole)
    want = models._pipeline(GBTClassifier(labelCol="label", seed=models.SEED, **whole), FEATURES).fit(coarse.orderBy("k").repartition(3))
    (weights, trees), (true_weights, true_trees) = shape(got), shape(want)
    assert weights == true_weights
    for one, other in zip(trees, true_trees, strict=True):
        assert one == pytest.approx(other, abs=1e-9)
    score = lambda model: [(r["prediction"], round(r["score"], 12)) for r in models.score(model, coarse).orderBy("k").collect()]
    assert score(got) == score(want)
    assert got.stages[-1].featureImportances.toArray() == pytest.approx(want.stages[-1].featureImportances.toArray())


def test_full_model_is_grown_on_blocks(coarse, monkeypatch):
    """No row is kept as an object: a pass reads blocks, a task one after another."""
    seen, grown = [], boosting.grown
    monkeypatch.setattr(boosting, "grown", lambda data, *more: seen.append(data) or grown(data, *more))
    monkeypatch.setattr(models.Pipeline, "fit", lambda self, df: pytest.fail("Spark's fit caches each row"))
    model = models.train_full_model(coarse, FEATURES)
    assert sum(len(b["label"]) // 4 for b in seen[0].collect()) == 3000 and seen[0].count() < 20
    columns = [len({x.split().featureIndex() for x in [t._call_java("rootNode")]}) for t in model.stages[-1].trees]
    assert len(columns) == models.FULL["maxIter"] == len(model.stages[-1].trees)
    again = models.train_full_model(coarse, FEATURES)
    assert shape(again) == shape(model)  # rows are drawn alike from the same input


def test_thresholds_lie_midway():
    values = np.arange(100.0)
    cuts = boosting.thresholds(values, np.ones(100, int), 4)
    assert cuts.tolist() == [24.5, 49.5, 74.5]
    assert boosting.thresholds(np.array([1.0, 3.0, 9.0]), np.array([1, 990, 1]), 32).tolist() == [2.0, 6.0]
    assert boosting.thresholds(np.array([5.0]), np.array([7]), 32).tolist() == boosting.thresholds(np.array([]), np.array([], int), 32).tolist() == []


def test_full_model_refuses_odd_rows_as_spark_does(coarse):
    for column, odd, why in (("label", F.lit(None).cast("int"), "labels must"), ("label", F.lit(2), "labels must"),
                             ("a", F.lit(float("nan")), "features must"), ("b", F.lit(None).cast("double"), "features must")):
        with pytest.raises(Exception, match=why):
            models.train_full_model(coarse.withColumn(column, F.when(F.col("k") == 5, odd).otherwise(F.col(column))), FEATURES)
