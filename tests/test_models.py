"""Training bounds, save and load, and Shapley values against their definition."""

from itertools import combinations
from math import factorial

import pytest
from pyspark.sql import functions as F

from vigilframe.operators import attribution, evaluation, models
from vigilframe.session import fresh_path

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    x = lambda m: ((F.col("id") * m) % 101 / 100.0)
    df = spark.range(600).select(F.col("id").alias("k"), x(7).alias("a"), x(13).alias("b"), x(29).alias("c"))
    return df.withColumn("label", ((F.col("a") > 0.5) & (F.col("b") < 0.6) | (F.col("c") > 0.9)).cast("int")).cache()


@pytest.fixture(scope="module")
def model(rows):
    return models.train_full_model(rows, FEATURES, maxIter=4)


def test_training_rows_are_spread_evenly(spark, monkeypatch):
    """However the input lies, no task of a fit holds more than its share."""
    seen = []
    fit = models.Pipeline.fit
    monkeypatch.setattr(models.Pipeline, "fit", lambda self, df: seen.append(df) or fit(self, df))
    lump = spark.range(20_000, numPartitions=1).selectExpr("CAST(id % 97 AS DOUBLE) AS a", "CAST(id % 89 AS DOUBLE) AS b", "CAST(id % 83 AS DOUBLE) AS c", "CAST(id % 2 AS INT) AS label")
    monkeypatch.setattr(models, "spread", lambda df, columns, most=1000, wide=models.spread: wide(df, columns, most))
    models.train_baseline(lump, FEATURES)
    sizes = [n for n in seen[0].rdd.glom().map(len).collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 1200


def test_quality(rows, model):
    q = models.evaluate_holdout(models.score(model, rows)).first()
    assert q["accuracy"] > 0.85 and q["auc_roc"] > 0.9


def test_save_load(spark, rows, model):
    path = fresh_path(spark, "model")
    models.save_model(model, path)
    want = models.predict_batch(model, rows, ["k"]).orderBy("k").collect()
    assert models.predict_batch(models.load_model(path), rows, ["k"]).orderBy("k").collect() == want


def test_additivity_and_margin(spark, rows, model):
    wide = attribution.explain_wide(rows, rows.limit(50), model, FEATURES, ["k"])
    gap = F.abs(F.col("phi_a") + F.col("phi_b") + F.col("phi_c") + F.col("base_value") - F.col("margin"))
    assert wide.agg(F.max(gap)).first()[0] < 1e-9
    both = wide.join(models.score(model, rows).select("k", "score"), "k")
    assert both.agg(F.max(F.abs(F.col("predicted_score") - F.col("score")))).first()[0] < 1e-9


def test_shapley_by_definition(spark, rows, model):
    leaves = attribution.leaf_boxes(spark, model)

    def value(x):
        return sum(v.value for v in leaves if all(low < x[FEATURES[i]] <= high for i, (low, high) in v.box.items()))

    back = [r.asDict() for r in rows.orderBy("k").limit(20).collect()]
    some = rows.filter("k % 97 = 0")
    got = {r["k"]: r for r in attribution.explain_wide(some, rows.orderBy("k").limit(20), model, FEATURES, ["k"]).collect()}
    for x in (r.asDict() for r in some.collect()):
        def game(players):
            return sum(value({f: (x if f in players else z)[f] for f in FEATURES}) for z in back) / len(back)

        for f in FEATURES:
            others = [g for g in FEATURES if g != f]
            phi = sum(
                factorial(len(s)) * factorial(2 - len(s)) / 6 * (game({*s, f}) - game(set(s)))
                for n in range(3) for s in combinations(others, n)
            )
            assert got[x["k"]][f"phi_{f}"] == pytest.approx(phi, abs=1e-9)


def test_leaf_membership_sums_to_margin(spark, rows, model):
    leaves = attribution.leaf_boxes(spark, model)
    members = attribution.leaf_membership(rows, model, ["k"]).join(attribution.leaf_values(spark, leaves), ["tree", "leaf"])
    sums = members.groupBy("k").agg(F.sum("value").alias("s"))
    wide = attribution.explain_wide(rows, rows.limit(10), model, FEATURES, ["k"]).select("k", "margin").join(sums, "k")
    assert wide.count() == 600
    assert wide.agg(F.max(F.abs(F.col("s") - F.col("margin")))).first()[0] < 1e-9


def test_cross_validation(rows):
    folds = models.cross_validate(rows, FEATURES, ["k"], k=2)
    got = evaluation.cv_summary(folds, ["accuracy"]).first()
    assert folds.count() == 2 and 0.7 < got["accuracy_mean"] <= 1


def test_learning_queries_read_all_flows(spark, small, monkeypatch):
    from vigilframe import plans
    from vigilframe.plans import learning

    flows = learning.prepared(spark, small).cache()
    full = models.train_full_model(flows, learning.FEATURES, maxIter=2)
    edge = models.train_edge_model(learning.edge_rows(flows), learning.flows.EDGE_FEATURES, maxIter=2)
    monkeypatch.setattr(learning, "trained", lambda spark, sf, kind: {"full": full, "edge": edge}[kind])
    want = sorted(r["flow_key"] for r in flows.select("flow_key").collect())
    for name, times in (("j7_predict_batch", 1), ("a16_save_load_model", 1), ("c10_rows_tree_leaves", 1), ("j9_explain_rows", len(learning.FEATURES))):
        got = sorted(r["flow_key"] for r in plans.QUERIES[name](spark, small).select("flow_key").collect())
        assert got == sorted(want * times), name
    long = attribution.explain_rows(flows, learning.background(spark, small), full, learning.FEATURES, ["flow_key"])
    mean = {r["name"]: r["score"] for r in attribution.mean_abs_attribution(long).collect()}
    assert {r["name"]: r["score"] for r in plans.QUERIES["d19_mean_abs_attribution"](spark, small).collect()} == pytest.approx(mean)


def test_margins_need_no_shuffle_of_rows(spark, rows, model):
    got = attribution.leaf_margins(rows, model, ["k"])
    members = attribution.leaf_membership(rows, model, ["k"])
    values = attribution.leaf_values(spark, attribution.leaf_boxes(spark, model))
    want = {r["k"]: r["m"] for r in members.join(values, ["tree", "leaf"]).groupBy("k").agg(F.sum("value").alias("m")).collect()}
    assert {r["k"]: r["margin"] for r in got.collect()} == pytest.approx(want, abs=1e-12)
    assert "hashpartitioning(k" not in got._jdf.queryExecution().toString()


def test_explaining_the_sample_sorts_no_other_rows(spark, small):
    from vigilframe.plans import learning

    assert learning.background(spark, small).count() == 512
    sample = learning.background(spark, small)
    plan = attribution.explain_rows(sample, sample, learning.trained(spark, small, "full"), learning.FEATURES, ["flow_key"])
    assert "rangepartitioning" not in plan._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def three(spark, small):
    """The scored test rows of the three kinds of models on the small flows."""
    from vigilframe.plans import learning

    return {kind: learning.test_scores(spark, small, kind).cache() for kind in ("full", "edge", "baseline")}


def plain_quality(scored):
    """Accuracy of the predictions (a score of exactly 0.5 is a 0), area by comparing all pairs, share of the 1s."""
    rows = [(r["score"], r["label"]) for r in scored.select("score", "label").collect()]
    good = [s for s, y in rows if y == 1]
    bad = [s for s, y in rows if y == 0]
    area = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    return sum((s > 0.5) == (y == 1) for s, y in rows) / len(rows), area, len(good) / len(rows)


@pytest.mark.parametrize("name,kind", [("j1_train_full_model", "full"), ("j2_train_edge_model", "edge"), ("j3_train_baseline", "baseline")])
def test_holdout_quality_of_each_model(spark, small, three, name, kind):
    from vigilframe import plans

    got = plans.QUERIES[name](spark, small).first()
    accuracy, area, share = plain_quality(three[kind])
    assert got["accuracy"] == pytest.approx(accuracy) and got["auc_roc"] == pytest.approx(area, abs=1e-9)
    assert got["accuracy"] > max(share, 1 - share) and got["auc_roc"] > 0.75  # better than the larger class


def test_importances_and_status(spark, small, three):
    from vigilframe import plans
    from vigilframe.plans import learning

    split = {r["name"]: r["score"] for r in plans.QUERIES["j6_feature_importances"](spark, small).collect()}
    assert set(split) == set(learning.FEATURES) and sum(split.values()) == pytest.approx(1) and min(split.values()) >= 0
    assert max(split, key=split.get) == "pkt_len_mean"  # the label's rule reads it
    sample = learning.background(spark, small)
    assert sample.count() == 512
    long = attribution.explain_rows(sample, sample, learning.trained(spark, small, "full"), learning.FEATURES, ["flow_key"])
    sums = {r["name"]: r["s"] / 512 for r in attribution.mean_abs_attribution(long).withColumn("s", F.col("score") * 512).collect()}
    rows = {r["name"]: r for r in plans.QUERIES["j10_global_importance"](spark, small).collect()}
    for n, r in rows.items():
        assert r["score"] == pytest.approx(sums[n]) and r["normalized_score"] == pytest.approx(sums[n] / max(sums.values()))
    scored = [(r["score"] > 0.5, r["label"] == 1) for r in three["full"].collect()]
    hits, said, true = sum(a and b for a, b in scored), sum(a for a, _ in scored), sum(b for _, b in scored)
    doc = plans.QUERIES["j18_model_status"](spark, small).first()
    assert (doc["model_loaded"], doc["feature_count"], doc["features"]) == (True, 5, learning.FEATURES)
    assert (doc["precision"], doc["recall"]) == pytest.approx((hits / said, hits / true))
    assert doc["f1_score"] == pytest.approx(2 * hits / (said + true))


def test_event_text_is_built_once(spark, small):
    """The text of an event is built once for each row, however many fields are read from it."""
    from vigilframe import plans

    plan = plans.QUERIES["b8_extract_src_ip"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object(props") <= 12


def test_attribution_of_odd_values_in_batches(spark, rows, model):
    """NULL, NaN and infinite values pass the tests that SQL says; the plan doesn't grow with the trees."""
    nan, inf = float("nan"), float("inf")
    odd = [(n, a, b, c) for n, (a, b, c) in enumerate([
        (a, b, c) for a in (None, nan, -inf, 0.5) for b in (None, nan, inf, 0.3) for c in (None, nan, inf, -inf, 0.95)])]
    df = spark.createDataFrame(odd, "k long, a double, b double, c double")
    leaves = attribution.leaf_boxes(spark, model)
    background = rows.orderBy("k").limit(20)
    tables, _ = attribution.contributions(leaves, attribution.background_masks(background, leaves, FEATURES))
    masks = {r["k"]: r["_masks"] for r in attribution.with_masks(df, leaves, FEATURES, ["k"]).collect()}
    wide = attribution.explain_wide(df, background, model, FEATURES, ["k"])
    for r in wide.collect():
        for n, name in enumerate(FEATURES):
            want = sum(float(t[n][m]) for t, m in zip(tables, masks[r["k"]]) if n in t)
            assert r[f"phi_{name}"] == pytest.approx(want, abs=1e-12)
        margin = sum(leaf.value for leaf, m in zip(leaves, masks[r["k"]]) if m == (1 << len(leaf.box)) - 1)
        assert r["margin"] == pytest.approx(margin, abs=1e-12)
    assert len(wide._jdf.queryExecution().optimizedPlan().toString()) < 20_000
