"""Event features, modelling and POT operators on rows counted by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from logtide.functions import extremes, reviews
from logtide.operators import candidates as K
from logtide.operators import extremes as X
from logtide.operators import metrics, modelling, pot
from logtide.plans import queries as Q

ROW = "window_id long, event_id long, event_order long, template string, novelty_score double, unseen boolean, is_new boolean"


def test_sequence_context_by_hand(spark):
    """Five alternating rows, the middle one unseen and new: 1 + 1 + 1 + 4 + 1."""
    rows = [(0, i, i, "ab"[i % 2], 1.0, i == 2, i == 2) for i in range(5)]
    got = {r.event_id: r for r in K.sequence_context(spark.createDataFrame(rows, ROW)).collect()}
    assert got[2].local_sequence_context_score == 8 and got[2].local_unseen_count_radius2 == 1
    assert got[2].distance_to_window_edge_ratio == 1 and got[0].distance_to_window_edge_ratio == 0 and got[4].relative_position_in_window == 1
    one = K.sequence_context(spark.createDataFrame([(0, 1, 1, None, 2.0, True, False)], ROW)).first()
    assert (one.neighbor_mean_novelty_score, one.relative_position_in_window, one.local_sequence_context_score) == (0, 0, 2)


def test_burst_is_the_unbroken_run(spark):
    on = [1, 1, 0, 1, 0, 1, 1, 1]
    rows = [(0, i, i, "t", 1.0, bool(x), False) for i, x in enumerate(on)]
    assert [r.burst for r in X.burst_runs(spark.createDataFrame(rows, ROW)).orderBy("event_id").collect()] == [2, 2, 0, 1, 0, 3, 3, 3]


def test_threshold_falls_back(spark):
    none = spark.createDataFrame([(0, float(i)) for i in range(11)], "label int, score double")
    assert tuple(metrics.choose_threshold(none, 0.5).first()) == (9.0, None, None)
    assert metrics.choose_threshold(spark.createDataFrame([(1, 2.0), (0, 1.0)], "label int, score double"), 1.0).first().threshold == 2.0


def test_answers():
    good = {"packet_id": "p", "review_decision": "likely_anomaly", "severity": "high", "confidence": 0.9, "reason_codes": ["rarity", "burst"], "rationale": "x", "suspicious_evidence": [], "benign_evidence": [], "recommended_action": "inspect_window", "needs_more_context": False}
    assert reviews.errors(reviews.normalise(good), "p") == []
    for change, word in (({"severity": "grave"}, "severity"), ({"needs_more_context": "no"}, "needs_more_context"), ({"rationale": " "}, "rationale"), ({"rationale": "the label says so"}, "label"), ({"rationale": "w " * 81}, "80"), ({"triage_score": 101}, "triage_score"), ({"review_priority": "now"}, "priority"), ({"benign_evidence": "x"}, "benign")):
        assert any(word in e for e in reviews.errors({**good, **change}, "p")), change
    calm = reviews.normalise({**good, "review_decision": "likely_normal", "review_priority": "high"})
    assert (calm["recommended_action"], calm["review_priority"]) == ("ignore", "low")
    kept = reviews.normalise({**good, "review_decision": "likely_normal", "needs_more_context": True})
    assert kept["recommended_action"] == "inspect_window" and reviews.errors(kept, "p")
    from pyspark.sql.types import DoubleType, StructField, StructType

    names = ["anomaly", "positive_events", "precision", "recall", "f1", "label", "score"]
    assert reviews.leaked(StructType([StructField(n, DoubleType()) for n in names])) == names[:-1]


def test_window_metadata(spark):
    rows = [(0, 1, "b"), (0, 2, "a"), (0, 3, "a"), (0, 4, "b"), (1, 5, None), (2, 6, "c")]
    m = spark.createDataFrame(rows, "window_id long, event_order long, block_id string").withColumn("ts", F.timestamp_seconds("event_order"))
    got = {r.window_id: r for r in modelling.window_metadata(m).collect()}
    assert (got[0].block_id, got[0].block_ids) == ("b", "a,b") and got[1].block_id is None and got[2].block_id == "c"
    assert got[0].end_time > got[0].start_time


def test_cluster_size_and_burst_pot(spark, sf_dir):
    m = Q.members(spark, sf_dir)
    sizes = modelling.cluster_sizes(m)
    values = [r["size"] for r in sizes.collect()]
    want, got = extremes.pot_fit(values, 0.9, 0.1), pot.global_pot(sizes, "size", 0.9)
    assert got["threshold_z"] == pytest.approx(want["threshold_z"], rel=1e-9)
    found = modelling.cluster_size_pot(sizes, got).agg(F.sum("num_pot_anomalies").alias("n")).first().n
    assert found == sum(v > want["threshold_z"] for v in values)
    runs = X.burst_runs(m)
    fit = pot.global_pot(runs, "burst", 0.5)
    ids = {r.event_id for r in runs.where(F.col("burst") > fit["threshold_z"]).collect()}
    row = modelling.post_pot_evaluation(pot.refine(runs, "burst", fit), Q.logs(spark, sf_dir)).first()
    labels = {r.event_id: r.label for r in Q.logs(spark, sf_dir).collect()}
    assert (row.candidates, row.tp, row.events) == (len(ids), sum(labels[i] for i in ids), len(labels))


def test_small_operators(spark):
    x = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", None), ("j", "z")], "key string, value string")
    assert {(r.key, r["mode"]) for r in modelling.modes(x, "key", "value").collect()} == {("k", "a"), ("j", "z")}
    best = modelling.select_best(spark.createDataFrame([("x", None, 1.0, 1.0), ("y", 0.5, 0.1, 0.2), ("z", 0.5, 0.2, 0.1)], "model string, precision double, recall double, f1 double"))
    assert best.first().model == "z"
    regions = spark.createDataFrame([(1,), (2,)], "region_id long")
    told = modelling.region_decisions(regions, spark.createDataFrame([("run:incident:2", "likely_normal")], "packet_id string, review_decision string"))
    assert {(r.region_id, r.selected) for r in told.collect()} == {(1, True), (2, False)}
    texts = spark.createDataFrame([("abc  def",), ("abc",)], "t string").select(modelling.truncated(F.col("t"), 5).alias("t"))
    assert [r.t for r in texts.collect()] == ["abc...[truncated]", "abc"]
