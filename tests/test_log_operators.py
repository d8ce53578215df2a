"""Fits, miners, buffers, loaders, packets and models against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logtide.functions import extremes, reviews, stability
from logtide.functions.drain import Drain
from logtide.operators import candidates, incidents, models, packets, parsing, pot, stream, windows
from logtide.plans import pipeline
from logtide.sources import loaders, sinks


def test_gev_fixture():
    l1, l2, t3 = extremes.sample_l_moments([4, 5, 8, 12, 20])
    assert (round(l1, 6), round(l2, 6), round(t3, 6)) == (9.8, 3.9, 0.384615)
    k, loc, scale, threshold = extremes.gev_from_moments(l1, l2, t3, 0.9)
    assert abs(k + 0.309007) < 1e-5 and abs(loc - 5.911927) < 1e-5 and abs(scale - 3.843999) < 1e-5 and abs(threshold - 18.407368) < 1e-4
    assert abs(extremes.gev_from_moments(*extremes.sample_l_moments([4, 5, 6, 25]), 0.75)[3] - 6.494678) < 1e-4
    with pytest.raises(ValueError):
        extremes.sample_l_moments([1, 2])


def test_pot_fixture():
    fit = extremes.pot_fit([1, 2, 3, 5, 8, 13, 21, 34], 0.75, 0.2)
    assert fit["threshold_u"] == 13 and fit["num_exceedances"] == 2 and fit["threshold_z"] >= 13
    x = np.random.default_rng(0).pareto(4, 20_000)
    xi, sigma = extremes.gpd_fit(x)
    assert abs(xi - 0.25) < 0.05 and abs(sigma - 0.25) < 0.02


def test_drain_groups_lines():
    d = Drain()
    a = [d.add(m)[0] for m in ("authentication failure for user root from 1.2.3.4", "authentication failure for user admin from 5.6.7.8", "accepted password for user root from 1.2.3.4")]
    assert a[0] is a[1] and a[1] is not a[2] and a[0].size == 2 and "<*>" in a[0].template
    assert d.match("authentication failure for user bob from 9.9.9.9").cluster_id == 1 and d.match("nothing like it") is None


def test_mine_and_match(spark):
    rows = [(b, i, i, f"job {i} {'done' if i % 3 else 'failed'} on host{b}", b) for b in range(2) for i in range(20)]
    x = spark.createDataFrame([(r[0] * 100 + r[1], r[0] * 100 + r[2], r[3], r[4]) for r in rows], "event_order long, event_id long, message string, block_id long")
    got = parsing.mine(x, "block_id").collect()
    assert len(got) == 40 and all(r.cluster_id is not None for r in got)
    miner = parsing.warm(x)
    assert parsing.match_reference(x, miner).where("is_known_template").count() == 40


def _machine(seeds, gap):
    out, open_ = [], {}
    for b, o in sorted(seeds):
        if b in open_ and o - open_[b][1] > gap:
            out.append((b, *open_.pop(b)))
        s = open_.setdefault(b, [o, o, 0])
        s[1], s[2] = o, s[2] + 1
    return sorted([*out, *((b, *s) for b, s in open_.items())])


def _seeds(spark):
    rng = random.Random(5)
    seeds = sorted({(b, rng.randrange(3000)) for b in range(4) for _ in range(40)})
    df = spark.createDataFrame([(b, o, b * 10_000 + o, f"t{o % 5}", float(o % 7), 1.0, "dense_novelty,x", 1) for b, o in seeds], "block_id long, event_order long, event_id long, template string, template_burst_score double, novelty_score double, trigger_reasons string, label int")
    return seeds, df


def test_buffer_batch_equals_machine_and_stream(spark, tmp_path):
    from logtide.streaming.incidents import run_available

    seeds, df = _seeds(spark)
    batch = incidents.incident_buffer(df, 60, 40).collect()
    assert sorted((r.block_id, r.start_order, r.end_order, r.seed_events) for r in batch) == _machine(seeds, 40)
    assert all(r.trigger_reasons == "dense_novelty,x" for r in batch)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    run_available(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "incidents_out", f"{tmp_path}/ck", max_gap=60, close_after=40)
    got = spark.table("incidents_out").collect()
    assert sorted((r.block_id, r.start_order, r.end_order, r.seed_events) for r in got) == _machine(seeds, 40)


def test_merge_and_cover(spark):
    rng = random.Random(2)
    rows = [(b, s, s + rng.randrange(30)) for b in range(3) for s in (rng.randrange(2000) for _ in range(60))]
    merged = {(r.block_id, r.interval_start, r.interval_end) for r in incidents.merge_intervals(spark.createDataFrame(rows, "block_id long, interval_start long, interval_end long")).collect()}
    want = set()
    for b in range(3):
        cells = sorted({x for k, s, e in rows if k == b for x in range(s, e + 1)})
        start = before = cells[0]
        for x in [*cells[1:], None]:
            if x is None or x > before + 1:
                want.add((b, start, before))
                start = x
            before = x
    assert merged == want
    points = [(b, o, o) for b in range(3) for o in range(0, 2100, 7)]
    hit = incidents.covered(spark.createDataFrame(points, "block_id long, event_order long, event_id long"), spark.createDataFrame(list(merged), "block_id long, interval_start long, interval_end long"), 50)
    assert {(r.block_id, r.event_order) for r in hit.collect()} == {(b, o) for b, o, _ in points if any(k == b and s <= o <= e for k, s, e in merged)}


@pytest.mark.parametrize("n", [1, 7, 10, 23, 40])
def test_count_windows(spark, n):
    size, stride = 10, 4
    got = {}
    for r in windows.count_windows(spark.range(n).selectExpr("id as i", f"{n}L as n"), size, stride).collect():
        got.setdefault(r.window_id, []).append(r.i)
    want = [list(range(s, s + size)) for s in range(0, n - size + 1, stride)] if n >= size else [list(range(n))]
    if n > size and want[-1][-1] != n - 1:
        want.append(list(range(n - size, n)))
    assert [sorted(got[k]) for k in sorted(got)] == want


def test_markov_matches_sequence(spark):
    rng = random.Random(4)
    rows = [(i // 60, i, i, rng.choice("abcde")) for i in range(240)]
    for order in (2, 3):
        got = {r.pos: r.surprise for r in candidates.markov_surprise(spark.createDataFrame(rows, "block_id long, pos long, event_id long, template string"), order).collect()}
        ctx, pair, seen, last = {}, {}, set(), {}
        for b, i, _, t in rows:
            h = last.setdefault(b, [])
            key = tuple(h[-(order - 1) :])
            s = 0.0
            if len(key) == order - 1:
                s = -math.log(max((pair.get((key, t), 0) + 0.1) / (ctx.get(key, 0) + 0.1 * max(1, len(seen))), 1e-12))
                ctx[key], pair[key, t] = ctx.get(key, 0) + 1, pair.get((key, t), 0) + 1
            seen.add(t)
            h.append(t)
            assert abs(got[i] - s) < 1e-9


def test_ordinal(spark):
    x = spark.createDataFrame([(i * 3 % 1009, "x") for i in range(1009)], "event_order long, v string").repartition(5)
    assert [r["ord"] for r in stream.ordinal(x).orderBy("event_order").collect()] == list(range(1009))


def test_json_answers():
    good = {"packet_id": "p", "review_decision": "likely_anomaly", "recommended_action": "inspect_event", "confidence": 0.5, "reason_codes": ["template_burst_score", "novelty_score", "rarity_score", "template_burst"], "severity": "low", "suspicious_evidence": ["a } b"], "benign_evidence": [], "needs_more_context": False, "rationale": "x"}
    import json

    answer, wrong = reviews.parse(f"prefix\n{json.dumps(good)}\ntrailing }}", "p")
    assert not wrong and answer["reason_codes"] == ["template_burst", "novel_template", "rare_template"]
    assert reviews.normalise({"review_decision": "likely_normal", "recommended_action": "inspect_template_cluster"})["recommended_action"] == "ignore"
    assert len(reviews.errors({**good, "packet_id": "q", "review_decision": "?", "rationale": "ground truth"}, "p")) >= 3
    assert reviews.parse("no answer", "p") == (None, ["no JSON object"])
    assert reviews.first_json_object('{"a": "\\"}"}') == '{"a": "\\"}"}'


def test_packets_hide_labels(spark, sf_dir, tmp_path):
    from logtide.plans.queries import event_table

    top = candidates.top_events(event_table(spark, sf_dir), "burst", 20)
    packs = packets.event_packets(top, "events", "burst")
    sinks.write_packets(packs, f"{tmp_path}/p")
    assert spark.read.json(f"{tmp_path}/p").count() == 20
    with pytest.raises(ValueError):
        packets.guarded(top)
    prompts = packets.render(packs, "Review:\n{{PACKET_JSON}}")
    dry = packets.review(prompts)
    assert dry.where("valid_json").count() == 0
    done = packets.review(prompts, packets.offline_reviewer)
    assert done.where("valid_json").count() == 20
    assert packets.review(prompts, packets.dry_run, done).where("valid_json").count() == 20
    clusters = packets.template_packets(top, "events", "burst")
    assert packets.members_of(clusters.select("packet_id"), clusters).count() == 20


def test_bootstrap():
    assert stability.summarise([0.8] * 10, "f1")["ci_low"] == pytest.approx(0.8)
    a = stability.bootstrap([1, 2, 3, 4], "x", resamples=500)
    assert a == stability.bootstrap([1, 2, 3, 4], "x", resamples=500) and a[0] < 2.5 < a[1]


def test_loaders(spark, tmp_path):
    (tmp_path / "BGL.log").write_text("- 1117838570 2005.06.03 R02-M1 RAS KERNEL INFO fine\n\nAPPREAD 1117869872 2005.06.04 R04 RAS APP FATAL ciod: failed, \"x\"\nshort\n")
    got = loaders.load_logs(spark, "bgl", f"file://{tmp_path}").orderBy("event_id").collect()
    assert [(r.event_id, r.label) for r in got] == [(1, 0), (3, 1)] and got[0].ts is not None and got[1].message.startswith("R04 RAS")
    (tmp_path / "HDFS_100k.log_structured.csv").write_text('LineId,Date,Time,Pid,Level,Component,Content,EventId,EventTemplate\n1,081109,203518,1,INFO,x,"Receiving block blk_-16, from a",E1,Receiving <*>\n2,081109,203519,1,INFO,x,Nothing here,E2,\n')
    (tmp_path / "anomaly_label.csv").write_text("BlockId,Label\nblk_-16,Anomaly\n")
    got = loaders.load_logs(spark, "hdfs100k", f"file://{tmp_path}").orderBy("event_id").collect()
    assert [(r.label, r.block_id, r.template) for r in got] == [(1, "blk_-16", "Receiving <*>"), (None, None, None)] and str(got[0].ts) == "2008-11-09 20:35:18"
    (tmp_path / "lnx.txt").write_text("Jun  9 06:06:20 combo syslogd  1.4.1: restart.\n[page: 2\nbad\nxx yy zz rest of it\n")
    got = loaders.load_logs(spark, "linux2k", f"file://{tmp_path}").orderBy("event_id").collect()
    assert [r.message for r in got] == ["combo syslogd 1.4.1: restart.", "rest of it"] and got[1].ts is None
    (tmp_path / "Thunderbird_2k.log").write_text("- 1131566461 2005.11.09 dn228 Nov 9 12:01:01 dn228/dn228 crond[2915]: (root) CMD\n")
    assert loaders.load_logs(spark, "thunderbird", f"file://{tmp_path}").first().label == 0
    (tmp_path / "OpenStack_2k.log_structured.csv").write_text("LineId,Logrecord,Date,Time,Pid,Level,Component,Content,EventId,EventTemplate\n1,a.log,2017-05-16,00:00:00.008,1,INFO,nova,hello,E1,hello\n")
    assert str(loaders.load_logs(spark, "openstack2k", f"file://{tmp_path}").first().ts).startswith("2017-05-16 00:00:00.008")
    (tmp_path / "HDFS_2k.log").write_text("a line\n\nb line\n")
    assert [r.event_id for r in loaders.load_logs(spark, "hdfs2k", f"file://{tmp_path}").collect()] == [1, 3]
    with pytest.raises(ValueError):
        loaders.load_logs(spark, "other", "")
    assert loaders.spread_starts([(i, 0) for i in range(11)], 3) == [0, 5, 10]


def test_models_and_pot(spark, sf_dir):
    rng = np.random.default_rng(0)
    rows = [(i, int(i % 5 == 0), *(rng.normal(size=3) + (3 if i % 5 == 0 else 0)).tolist()) for i in range(400)]
    x = spark.createDataFrame(rows, "event_id long, label int, a double, b double, c double")
    cols = ["a", "b", "c"]
    for scored in (models.logistic_scores(x, x, cols), models.pca_scores(x.where("label = 0"), x, cols, 1), models.isolation_forest_scores(x.where("label = 0"), x, cols, trees=30)):
        r = scored.groupBy("label").agg(F.avg("score").alias("s")).orderBy("label").collect()
        assert r[1].s > r[0].s
    m = spark.createDataFrame([(w, i, v) for w, vs in ((0, [0.2, 0.4, 3.0]), (1, [0.1, 4.0])) for i, v in enumerate(vs)], "window_id long, event_id long, v double")
    fit = pot.global_pot(m, "v", 0.7)
    assert fit["threshold_u"] == 0.4 and fit["num_exceedances"] == 2
    assert pot.refine(m, "v", fit).count() == 2 and pot.per_window_pot(m, "v", 0.6, 0.3).count() == 2


def test_pipeline_run(spark, sf_dir, tmp_path):
    (tmp_path / "c.yaml").write_text(f"path: {sf_dir}\nsize: 50\nstride: 25\npot_enabled: true\npot_quantile: 0.3\nstatistics: unique_templates, rare_template_ratio\n")
    out = pipeline.run(spark, pipeline.load_settings(str(tmp_path / "c.yaml")))
    assert out["evaluation"].count() == 1 and out["windows"].count() > 5 and set(out) >= {"pot", "candidates"}
    (tmp_path / "HDFS_2k.log").write_text("".join(f"job {i % 7} step {i} {'ok' if i % 9 else 'failed'}\n" for i in range(300)))
    got = pipeline.run(spark, pipeline.Settings(dataset="hdfs2k", path=f"file://{tmp_path}", size=20, stride=10))
    assert got["windows"].count() == 20
