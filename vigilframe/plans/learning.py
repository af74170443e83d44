"""Models, their evaluation, attribution, and the texts derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.operators import attribution, boosting, evaluation, exact, flows, importance, models, narrative, summary
from vigilframe.plans.lookups import NORM, TOPIP, WEIGHTED, WIN, attack_telemetry, norm_importance
from vigilframe.plans.registry import query
from vigilframe.plans.scalar import ASOF
from vigilframe.plans.topk import contributions
from vigilframe.session import fresh_path, written
from vigilframe.sources import views

FEATURES = list(flows.FLOW_FEATURES)
_MODELS: dict = {}


_PREPARED: dict = {}


def prepared(spark, sf):
    """Flows cleaned in the default order, with an integer label. Written once: leaving out copies shuffles all rows."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _PREPARED:
        f = views.flows(spark, sf).select("flow_key", *FEATURES, "raw_label")
        _PREPARED[key] = written(flows.preprocess(f, "raw_label", FEATURES).drop("raw_label"), "prepared")
    return _PREPARED[key]


_PARTS: dict = {}


def parts(spark, sf):
    """Training and test rows. The split is written once: a fit reads its input many times.

    The parts lie in the same files: folders of their own would have all rows sorted by part.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _PARTS:
        _PARTS[key] = written(exact.stratified_split(prepared(spark, sf), "label", ["flow_key"]), "split")
    return tuple(_PARTS[key].where(F.col("part") == part).drop("part") for part in ("train", "test"))


def edge_rows(rows):
    named = rows.withColumnsRenamed({"pkt_len_mean": "Packet Length Mean", "dst_port": "Destination Port"})
    return flows.edge_feature_projection(named, keep=["flow_key", "label"])


def trained(spark, sf, kind):
    """Models are fitted once per session and input folder."""
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _MODELS:
        train, _ = parts(spark, sf)
        if kind == "full":
            fit = lambda: models.train_full_model(train, FEATURES)
        elif kind == "edge":
            fit = lambda: models.train_edge_model(edge_rows(train), flows.EDGE_FEATURES)
        else:
            fit = lambda: models.train_baseline(edge_rows(train), flows.EDGE_FEATURES)
        _MODELS[key] = models.timed(fit)[0]
    return _MODELS[key]


def test_scores(spark, sf, kind="full"):
    _, test = parts(spark, sf)
    return models.score(trained(spark, sf, kind), test if kind == "full" else edge_rows(test))


@query("j1_train_full_model")
def full(spark, sf):
    return models.evaluate_holdout(test_scores(spark, sf, "full"))


@query("j1_train_regularised")
def regularised(spark, sf):
    """Boosted trees with an L2 penalty and columns drawn per tree, on the test part."""
    train, test = parts(spark, sf)
    model = boosting.train(train, FEATURES)[0]
    return models.evaluate_holdout(boosting.score(model, test))


@query("j2_train_edge_model")
def edge(spark, sf):
    return models.evaluate_holdout(test_scores(spark, sf, "edge"))


@query("j3_train_baseline")
def baseline(spark, sf):
    return models.evaluate_holdout(test_scores(spark, sf, "baseline"))


@query("j4_evaluate_holdout")
def holdout(spark, sf):
    return evaluation.classification_report(test_scores(spark, sf))


@query("j5_cross_validate")
def cross(spark, sf):
    folds = models.cross_validate(prepared(spark, sf), FEATURES, ["flow_key"])
    return evaluation.cv_summary(folds, ["accuracy", "auc_roc"])


@query("j6_feature_importances")
def importances(spark, sf):
    return models.feature_importances(spark, trained(spark, sf, "full"), FEATURES)


@query("j7_predict_batch")
def predict(spark, sf):
    return models.predict_batch(trained(spark, sf, "full"), prepared(spark, sf), ["flow_key"])


@query("a16_save_load_model")
def save_load(spark, sf):
    path = fresh_path(spark, "model")
    models.save_model(trained(spark, sf, "edge"), path)
    return models.predict_batch(models.load_model(path), edge_rows(prepared(spark, sf)), ["flow_key"])


@query("j8_score_label", "telemetry", """
WITH s AS (SELECT seq, tanh((confidence + vector / 360 + k / CAST(100 AS DOUBLE)) / (3 + 1e-6)) AS score FROM telemetry)
SELECT seq, round(score, 9) AS score, CASE WHEN score >= 0.5 THEN 'ANOMALY' ELSE 'NORMAL' END AS label FROM s""")
def score_label(spark, sf):
    s = views.telemetry(spark, sf).select(
        "seq", models.heuristic_score([F.col("confidence"), F.col("vector") / 360, F.col("k") / 100]).alias("score"))
    return s.select("seq", F.round("score", 9).alias("score"), models.score_label(F.col("score")).alias("label"))


_BACKGROUND: dict = {}


def background(spark, sf):
    """Written once: a Python column on the sample would move below its limit, and all rows be sorted for it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BACKGROUND:
        train, _ = parts(spark, sf)
        _BACKGROUND[key] = written(exact.sample_n(train, ["flow_key"], 512), "background")
    return _BACKGROUND[key]


@query("j9_explain_rows")
def explain(spark, sf):
    return attribution.explain_rows(prepared(spark, sf), background(spark, sf), trained(spark, sf, "full"), FEATURES, ["flow_key"])


@query("d19_mean_abs_attribution")
def mean_abs(spark, sf):
    return attribution.mean_abs_attribution(explain(spark, sf))


@query("j10_global_importance")
def global_importance(spark, sf):
    """Defined on the sample: its own rows against themselves."""
    sample = background(spark, sf)
    long = attribution.explain_rows(sample, sample, trained(spark, sf, "full"), FEATURES, ["flow_key"])
    return importance.normalise_importance(attribution.mean_abs_attribution(long))


@query("c10_rows_tree_leaves")
def tree_leaves(spark, sf):
    """Margin of every row, summed over its leaves by a join with the leaf table."""
    return attribution.leaf_margins(prepared(spark, sf), trained(spark, sf, "full"), ["flow_key"])


@query("j11_weighted_attribution", "telemetry importance", f"""WITH {WEIGHTED.strip()}
SELECT feature, count(*) AS rows, round(sum(abs(value)), 3) AS total FROM contributions GROUP BY 1""")
def weighted(spark, sf):
    return contributions(spark, sf).groupBy("feature").agg(F.count("*").alias("rows"), F.round(F.sum(F.abs("value")), 3).alias("total"))


@query("j12_uniform_importance", "importance", """
SELECT name, round(CAST(100 AS DOUBLE) / (SELECT count(*) FROM importance), 2) AS percent, CAST(1 AS DOUBLE) / (SELECT count(*) FROM importance) AS share FROM importance""")
def uniform(spark, sf):
    return importance.uniform_importance(views.importance(spark, sf).select("name"))


DOC = f"""{WIN}, {TOPIP},
s AS (SELECT count(*) AS total, round(count(*) FILTER (attack) / CAST(5 AS DOUBLE), 2) AS rate FROM win),
spine AS (SELECT unnest(generate_series({ASOF} - INTERVAL 4 MINUTE, {ASOF}, INTERVAL 1 MINUTE)) AS minute),
m AS (SELECT date_trunc('minute', ts) AS minute, count(*) AS count FROM win GROUP BY 1),
t AS (SELECT minute, coalesce(count, 0) AS count FROM spine LEFT JOIN m USING (minute)),
ip AS (SELECT src_ip AS v, count AS c FROM top ORDER BY count DESC, last DESC LIMIT 1),
port AS (SELECT CAST(dst_port AS VARCHAR) AS v, count(*) AS c FROM win GROUP BY 1 ORDER BY 2 DESC, max(seq) DESC LIMIT 1),
pr AS (SELECT proto AS v FROM win GROUP BY 1 ORDER BY count(*) DESC, max(seq) DESC LIMIT 1),
lastb AS (SELECT arg_max(count, minute) AS l, (CAST(sum(count) AS DOUBLE) - arg_max(count, minute)) / (count(*) - 1) AS mean FROM t)"""


def document(spark, sf):
    return summary.attack_summary(attack_telemetry(spark, sf), views.AS_OF, 5)


@query("j13_incident_narrative", "telemetry", f"""WITH {DOC}
SELECT concat_ws(' ', printf('01:00 UTC: %d hostile events in the past 5 minutes, or %.1f a minute.', total, rate),
 printf('%s sent %d%% of them, more than any other address.', ip.v, CAST(round(ip.c / CAST(total AS DOUBLE) * 100) AS BIGINT)),
 printf('Port %s was hit most often, %.1f times.', port.v, CAST(port.c AS DOUBLE)), printf('The leading protocol is %s.', pr.v),
 CASE WHEN l > mean * 1.5 AND l >= 3 THEN 'The latest minute is well above the ones before it: look into it first.' WHEN l <= mean * 0.5 AND mean > 0 THEN 'The latest minute is calmer than the ones before it.' END,
 'Next: check whether the listed sources are blocked.') AS narrative FROM s, ip, port, pr, lastb""")
def incident(spark, sf):
    return narrative.incident_narrative(document(spark, sf), views.as_of(), 5)


@query("j14_model_summary_text", "telemetry importance", f"""WITH {NORM},
r AS (SELECT name, CASE WHEN normalized_score > 0.65 THEN 'rising' ELSE 'elevated' END AS sig, row_number() OVER (ORDER BY normalized_score DESC, name) AS n FROM norm)
SELECT concat('Strongest signals of the past 15 minutes: ', string_agg(concat(name, ' (', sig, ')'), ', ' ORDER BY n), '.') AS text FROM r WHERE n <= 3""")
def model_text(spark, sf):
    return narrative.model_summary_text(importance.top_feature_signals(norm_importance(spark, sf), 5), 900)


@query("j15_diagnosis_patterns", "telemetry importance", f"""WITH {DOC}, {NORM},
f AS (SELECT name, normalized_score AS w FROM norm ORDER BY normalized_score DESC, name LIMIT 1),
h AS (SELECT minute, count FROM (SELECT * FROM t ORDER BY minute DESC LIMIT 3) WHERE count >= 5 ORDER BY minute LIMIT 1)
SELECT 0 AS pos, concat('ip-', v) AS id, concat('Many events from ', v) AS title, CAST(least(99, 60 + c) AS INT) AS confidence, {ASOF} AS last_seen FROM ip
UNION ALL SELECT 1, concat('feature-', name), concat('The model relies on ', name), CAST(round(w * 100) AS INT), {ASOF} - INTERVAL 4 MINUTE FROM f
UNION ALL SELECT 2, concat('spike-', strftime(minute, '%H:%M')), 'A busy minute', CAST(least(95, count * 12) AS INT), {ASOF} - INTERVAL 2 MINUTE FROM h""")
def diagnosis(spark, sf):
    top = norm_importance(spark, sf).orderBy(F.col("normalized_score").desc(), "name").limit(1)
    found = narrative.diagnosis_patterns(document(spark, sf), top.select("name", F.col("normalized_score").alias("importance")), views.as_of())
    return found.select("pos", "id", "title", "confidence", "last_seen")


@query("j16_cycle_summary_text", "telemetry", f"""WITH {DOC}
SELECT concat_ws(' ', printf('Hostile events this cycle: %d (%.1f a minute).', total, rate), printf('Busiest source: %s.', ip.v),
 printf('Busiest protocol: %s.', pr.v)) AS text FROM s, ip, pr""")
def cycle_text(spark, sf):
    return narrative.cycle_summary_text(document(spark, sf))


@query("j17_attribution_pattern", "telemetry importance", f"""WITH {WEIGHTED.strip()},
b AS (SELECT row_id, arg_max(feature, (abs(value), feature)) AS f, arg_max(value, (abs(value), feature)) AS v FROM contributions GROUP BY 1)
SELECT row_id, concat('Main driver: ', f) AS title, CAST(CASE WHEN row_id % 2 = 0 THEN 72 ELSE round(confidence * 100) END AS INT) AS confidence
FROM b JOIN telemetry ON seq = row_id""")
def attribution_pattern(spark, sf):
    p = views.telemetry(spark, sf).select(F.col("seq").alias("row_id"), F.when(F.col("seq") % 2 == 1, F.col("confidence")).alias("prediction"))
    return narrative.attribution_pattern(contributions(spark, sf).join(p, "row_id")).select("row_id", "title", "confidence")


@query("j18_model_status")
def status(spark, sf):
    rep = evaluation.classification_report(test_scores(spark, sf)).filter(F.col("class") == "1")
    doc = rep.select(F.lit("full").alias("model_name"), F.array(*[F.lit(f) for f in FEATURES]).alias("features"), "precision", "recall", F.col("f1").alias("f1_score"))
    return models.model_status(doc)


@query("j19_class_balance", "flows", """
SELECT raw_label AS class, count(*) AS rows, CAST(sum(count(*)) OVER () AS BIGINT) AS total_rows, 5 AS total_features, CAST(1 AS DOUBLE) AS sample_fraction, 'all flows' AS note FROM flows GROUP BY 1""")
def balance(spark, sf):
    return evaluation.class_balance(views.flows(spark, sf).select(*FEATURES, "raw_label"), "raw_label", 1.0, "all flows")
