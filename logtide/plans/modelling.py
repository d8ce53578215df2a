"""Queries of the modelling table, summaries and retrieval, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import candidates as K
from ..operators import extremes as X
from ..operators import incidents as I
from ..operators import metrics as M
from ..operators import modelling as T
from ..operators import windows as W
from . import queries as Q
from .queries import query, rounded


def table(spark, d):
    own = Q.features(spark, d)
    return T.modelling_table(own, X.ensemble(X.gev_scores(own)))


@query
def window_metadata(spark, d):
    m = T.window_metadata(Q.members(spark, d))
    return m.select("window_id", "num_records", F.unix_micros(F.col("start_time").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("end_time").cast("timestamp")).alias("end_us"), "block_id", "block_ids")


@query
def modelling_table(spark, d):
    return rounded(table(spark, d), 5)


@query
def gev_baseline(spark, d):
    return rounded(T.gev_baseline(table(spark, d)))


@query
def overfitting_risk(spark, d):
    return T.overfitting_risk(table(spark, d))


@query
def gev_score_scorer(spark, d):
    """Average precision of the GEV score, and the fixed flag's confusion, over all windows."""
    t = table(spark, d)
    return rounded(M.average_precision(t.select("label", F.col("gev_score").alias("score"))).crossJoin(M.at_threshold(t.select("label", F.col("gev_is_suspicious").cast("double").alias("score")), 0.5).select("tp", "fp", "fn", "tn")))


@query
def fold_averages(spark, d):
    """The novelty score at 1.0 on each fold's test blocks: micro and macro averages."""
    s = Q.stream(spark, d)
    return rounded(T.fold_averages(T.fold_metrics(s.select("block_id", "label", F.col("novelty_score").alias("score")), M.block_folds(s), 1.0)))


@query
def infer_totals(spark, d):
    return T.infer_totals(Q.event_table(spark, d))


@query
def setting_ranking(spark, d):
    """Novelty thresholds ranked by 0.60 recall + 0.25 precision + 0.15 (1 - load)."""
    s = Q.stream(spark, d)
    grid = F.broadcast(spark.createDataFrame([(float(t),) for t in (0.25, 0.5, 1.0, 1.5, 2.0)], "threshold double"))
    hit, label = F.col("novelty_score") >= F.col("threshold"), F.col("label") == 1
    cells = s.crossJoin(grid).groupBy("threshold").agg(F.count("*").alias("n"), F.count_if(hit).alias("chosen"), F.count_if(hit & label).alias("tp"), F.count_if(label).alias("all"))
    x = cells.select("threshold", X.ratio(F.col("tp"), F.col("chosen")).alias("precision"), X.ratio(F.col("tp"), F.col("all")).alias("recall"), (F.col("chosen") / F.col("n")).alias("load"))
    return rounded(x.withColumn("rank_score", T.setting_score(F.col("precision"), F.col("recall"), F.col("load"))))


@query
def method_sweep(spark, d):
    """Two rankings at two budgets: events, positives and gap clusters of what they choose; each event is ranked once a method."""
    c = Q.event_table(spark, d)
    best = None
    for method in ("burst", "novelty"):
        top = K.top_events(c, method, 100).select(F.lit(method).alias("method"), "rank", "block_id", "event_order", "event_id", "label")
        best = top if best is None else best.union(top)
    grid = F.broadcast(spark.createDataFrame([(20,), (100,)], "k int"))
    x = best.join(grid, F.col("rank") <= F.col("k"))
    w = Window.partitionBy("method", "k", "block_id").orderBy("event_order", "event_id")
    new = F.when(F.coalesce(F.col("event_order") - F.lag("event_order").over(w) > 50, F.lit(True)), 1).otherwise(0)
    return rounded(x.withColumn("new", new).groupBy("method", "k").agg(F.count("*").alias("events"), F.count_if(F.col("label") == 1).alias("positives"), F.sum("new").alias("clusters")))


@query
def cluster_modes(spark, d):
    """The commonest template of the anomalies of each block; blocks with two of them or more."""
    a = Q.logs(spark, d).where("label = 1")
    several = a.groupBy("block_id").agg(F.count("*").alias("anomalies")).where("anomalies >= 2")
    return T.modes(a, "block_id", "template").join(several, "block_id").select("block_id", "mode", "n", "anomalies")


@query
def cluster_summary(spark, d):
    return T.cluster_summary(Q.logs(spark, d))


@query
def retrieval_corpus(spark, d):
    c = T.retrieval_corpus(Q.event_table(spark, d))
    return rounded(c.select("event_id", "block_id", "novelty_score", T.truncated(F.col("text"), 40).alias("text")), 5)


@query
def retrieval_outside(spark, d):
    """Corpus rows of templates that the 20 first events have, those events left out."""
    c = Q.event_table(spark, d)
    top = K.top_events(c, "burst", 20)
    same = T.outside(T.retrieval_corpus(c), top).join(top.select("template").distinct(), "template", "left_semi")
    return rounded(same.groupBy("template").agg(F.count("*").alias("events"), F.min("template_burst_score").alias("lowest_burst")), 5)


@query
def region_coverage(spark, d):
    """Anomalies in selected and in ignored regions; the decision stands in for a reviewer's and follows from the region's number."""
    regions = I.incident_buffer(Q._seeds(spark, d)).withColumn("region_id", F.row_number().over(Window.orderBy("block_id", "start_order")).cast("long"))  # a row a region
    reviews = regions.selectExpr("concat('incident:', region_id) as packet_id", "case when region_id % 3 = 0 then 'likely_normal' else 'likely_anomaly' end as review_decision")
    told = T.region_decisions(regions, reviews).select("block_id", "interval_start", "interval_end", "selected")
    a = Q.logs(spark, d).where("label = 1").select("block_id", "event_order", "event_id")
    bins = told.withColumn("bin", F.explode(F.expr("sequence(interval_start div 1000, interval_end div 1000)")))
    hit = a.withColumn("bin", F.expr("event_order div 1000")).join(bins, ["block_id", "bin"]).where("event_order between interval_start and interval_end")
    best = hit.groupBy("event_id").agg(F.max("selected").alias("selected"))
    return a.join(best, "event_id", "left").agg(F.count("*").alias("anomalies"), F.count_if("selected").alias("in_selected"), F.count_if(~F.col("selected")).alias("in_ignored"))


@query
def stream_half(spark, d):
    """The second half of the stream by position, its blocks, and the blocks that only the first half has."""
    s = Q.stream(spark, d).select("i", "n", "block_id")
    sides = s.groupBy("block_id").agg(F.count_if(F.col("i") >= F.col("n") / 2).alias("second"), F.count_if(F.col("i") < F.col("n") / 2).alias("first"))
    return sides.agg(F.sum("second").alias("rows"), F.count_if(F.col("second") > 0).alias("blocks"), F.count_if(F.col("second") == 0).alias("only_first"))


@query
def packet_page(spark, d):
    """Packets 11 to 20 of a ranking."""
    return rounded(K.top_events(Q.event_table(spark, d), "deviation", 20).orderBy("rank").offset(10).limit(10).select("rank", "event_id"))


@query
def window_sweep(spark, d):
    """Sizes and overlaps of count windows: how many windows, and how many members."""
    s = Q.stream(spark, d)
    out = None
    for size in (50, 100):
        for overlap in (0.0, 0.5):
            m = W.count_windows(s, size, max(1, int(size * (1 - overlap)))).agg(F.countDistinct("window_id").alias("windows"), F.count("*").alias("members")).select(F.lit(size).cast("long").alias("size"), F.lit(overlap).alias("overlap"), "windows", "members")
            out = m if out is None else out.union(m)
    return out


@query
def cluster_size_pot(spark, d):
    """Clusters above a POT threshold of all cluster sizes."""
    from ..operators import pot

    sizes = T.cluster_sizes(Q.members(spark, d))
    found = T.cluster_size_pot(sizes, pot.global_pot(sizes, "size", 0.9))
    return found.withColumn("candidate_event_ids", F.array_join(F.col("candidate_event_ids").cast("array<string>"), ","))


@query
def burst_pot(spark, d):
    """Events in unbroken unseen-or-new runs above a POT threshold of all runs, evaluated by the stream's labels."""
    from ..operators import pot

    m = X.burst_runs(Q.members(spark, d))
    return rounded(T.post_pot_evaluation(pot.refine(m, "burst", pot.global_pot(m, "burst", 0.5)), Q.logs(spark, d)))


_TABLE = """, g AS (SELECT window_id, max(value) AS gev_score FROM scores GROUP BY window_id), z AS (SELECT window_id, CASE WHEN count(*) OVER w < 3 OR stddev_pop(ln(1 + num_records)) OVER w < 1e-12 THEN 0 ELSE (ln(1 + num_records) - avg(ln(1 + num_records)) OVER w) / stddev_pop(ln(1 + num_records)) OVER w END AS count_z_baseline
FROM features WINDOW w AS (ORDER BY window_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT f.window_id, CASE WHEN f.window_id < a THEN 'train' WHEN f.window_id < greatest(a + 1, floor(n * 0.75)) THEN 'validation' ELSE 'test' END AS split, 1::BIGINT AS population_all_windows, is_suspicious::BIGINT AS population_post_gev, f.window_label AS label, num_anomalous / nullif(num_labeled, 0) AS anomaly_event_ratio,
  gev_score, max_excess AS gev_excess, f.num_records::DOUBLE AS log_count, unique_templates::DOUBLE AS distinct_templates, template_entropy, rare_template_ratio, unseen_template_ratio, new_template_ratio, mean_novelty_score AS mean_event_novelty_score, count_z_baseline, is_suspicious::BIGINT AS gev_is_suspicious
  FROM features f JOIN flagged USING (window_id) JOIN g USING (window_id) JOIN z USING (window_id), (SELECT count(*) AS n, greatest(1, floor(count(*) * 0.5)) AS a FROM features))
"""
_CELLS = "CAST(count_if(gev_is_suspicious = 1 AND label = 1) AS BIGINT) AS tp, CAST(count_if(gev_is_suspicious = 1 AND label = 0) AS BIGINT) AS fp, CAST(count_if(gev_is_suspicious = 0 AND label = 0) AS BIGINT) AS tn, CAST(count_if(gev_is_suspicious = 0 AND label = 1) AS BIGINT) AS fn"
_RANKED = "template_burst_score DESC, template_count_deviation_score DESC, novelty_score DESC, rarity_score DESC, event_order, event_id"

SQL = {
    "window_metadata": ("members", """, b AS (SELECT window_id, block_id, count(*) AS n, min(event_order) AS f FROM members GROUP BY ALL)
SELECT window_id, count(*) AS num_records, epoch_us(arg_min(ts, event_order)) AS start_us, epoch_us(arg_max(ts, event_order)) AS end_us, any_value(k.block_id) AS block_id, any_value(k.ids) AS block_ids
FROM members m JOIN (SELECT window_id, first(block_id ORDER BY n DESC, f) AS block_id, string_agg(CAST(block_id AS VARCHAR), ',' ORDER BY block_id) AS ids FROM b GROUP BY window_id) k USING (window_id) GROUP BY window_id"""),
    "modelling_table": ("features flagged scores", _TABLE + "SELECT window_id, split, population_all_windows, population_post_gev, label, gev_is_suspicious, round(COLUMNS(* EXCLUDE (window_id, split, population_all_windows, population_post_gev, label, gev_is_suspicious)), 5) FROM t"),
    "gev_baseline": ("features flagged scores", _TABLE + f"SELECT split, tp, fp, tn, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0) * (CASE WHEN tp > 0 THEN 1 END), 6) AS f1, round((tp + fp) / n, 6) AS forwarded_window_ratio FROM (SELECT coalesce(split, 'all') AS split, {_CELLS}, count(*) AS n FROM t GROUP BY ROLLUP (split))"),
    "overfitting_risk": ("features flagged scores", _TABLE + "SELECT *, CASE WHEN positives < 20 OR windows < 100 THEN 'high' WHEN positives < 50 OR windows < 300 THEN 'medium' ELSE 'low' END AS level FROM (SELECT count(*) AS windows, CAST(count_if(label = 1) AS BIGINT) AS positives FROM t WHERE population_post_gev = 1)"),
    "gev_score_scorer": ("features flagged scores", _TABLE + f""", s AS (SELECT gev_score AS v, sum(label) AS p, sum(1 - label) AS q FROM t WHERE label IS NOT NULL GROUP BY 1), c AS (SELECT *, sum(p) OVER (ORDER BY v DESC) AS tp, sum(q) OVER (ORDER BY v DESC) AS fp, sum(p) OVER () AS ap, sum(q) OVER () AS an FROM s)
SELECT round(sum(p * c.tp / (c.tp + c.fp)) / nullif(any_value(ap), 0) * any_value(CASE WHEN an > 0 THEN 1 END), 6) AS average_precision, round(sum(q * (c.tp - p / 2)) / nullif(any_value(ap) * any_value(an), 0), 6) AS roc_auc, CAST(any_value(ap) AS BIGINT) AS positives, CAST(any_value(an) AS BIGINT) AS negatives, any_value(k.tp) AS tp, any_value(k.fp) AS fp, any_value(k.fn) AS fn, any_value(k.tn) AS tn FROM c, (SELECT {_CELLS} FROM t) k"""),
    "fold_averages": ("stream", """, b AS (SELECT block_id, min(event_order) AS f, max(label) AS pos FROM stream GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY f) - 1 AS k, sum(pos) OVER () AS m FROM b),
tests AS (SELECT p.k AS fold, o.block_id FROM k o JOIN k p ON p.pos = 1 AND p.m >= 3 AND ((o.pos = 1 AND o.k = p.k) OR (o.pos = 0 AND o.k % o.m = p.k))),
c AS (SELECT fold, count_if(novelty_score >= 1 AND label = 1) AS tp, count_if(novelty_score >= 1 AND label = 0) AS fp, count_if(novelty_score < 1 AND label = 1) AS fn FROM stream JOIN tests USING (block_id) GROUP BY fold), r AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM c)
SELECT count(*) AS folds, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(avg(p), 6) AS macro_precision, round(stddev_pop(p), 6) AS std_precision, round(avg(r), 6) AS macro_recall, round(stddev_pop(r), 6) AS std_recall, round(sum(tp) / nullif(sum(tp + fp), 0), 6) AS micro_precision, round(sum(tp) / nullif(sum(tp + fn), 0), 6) AS micro_recall FROM r"""),
    "infer_totals": ("cands", "SELECT max(event_order) + 1 AS events_by_max, max(event_order) - min(event_order) + 1 AS events_by_span, CAST(count_if(label = 1) AS BIGINT) AS anomalies FROM cands"),
    "setting_ranking": ("stream", """SELECT threshold, round(p, 6) AS precision, round(r, 6) AS recall, round(l, 6) AS load, round(0.60 * coalesce(r, 0) + 0.25 * coalesce(p, 0) + 0.15 * (1 - l), 6) AS rank_score FROM (SELECT threshold, count_if(novelty_score >= threshold AND label = 1) / nullif(count_if(novelty_score >= threshold), 0) AS p, count_if(novelty_score >= threshold AND label = 1) / nullif(count_if(label = 1), 0) AS r, count_if(novelty_score >= threshold) / count(*) AS l
FROM stream, (SELECT unnest([0.25, 0.5, 1.0, 1.5, 2.0]::DOUBLE[]) AS threshold) GROUP BY threshold)"""),
    "method_sweep": ("cands", f""", r AS (SELECT 'burst' AS method, *, row_number() OVER (ORDER BY {_RANKED}) AS rank FROM cands UNION ALL SELECT 'novelty', *, row_number() OVER (ORDER BY novelty_score DESC, {_RANKED}) FROM cands)
SELECT method, CAST(k AS BIGINT) AS k, count(*) AS events, CAST(count_if(label = 1) AS BIGINT) AS positives, CAST(sum(new) AS BIGINT) AS clusters FROM (SELECT method, k, label, CASE WHEN coalesce(event_order - lag(event_order) OVER (PARTITION BY method, k, block_id ORDER BY event_order) > 50, true) THEN 1 ELSE 0 END AS new FROM r JOIN (SELECT unnest([20, 100]) AS k) ON rank <= k) GROUP BY method, k"""),
    "cluster_modes": ("anoms", "SELECT block_id, mode, n, anomalies FROM (SELECT block_id, template AS mode, count(*) AS n, sum(count(*)) OVER (PARTITION BY block_id)::BIGINT AS anomalies, row_number() OVER (PARTITION BY block_id ORDER BY count(*) DESC, template) AS k FROM anoms GROUP BY block_id, template) WHERE k = 1 AND anomalies >= 2"),
    "cluster_summary": ("logs", "SELECT template, count(*) AS size, array_to_string(list(message ORDER BY event_order)[:3], ' | ') AS examples, min(event_order) AS first_order FROM logs GROUP BY template"),
    "retrieval_corpus": ("cands", "SELECT event_id, block_id, round(novelty_score, 5) AS novelty_score, CASE WHEN length(t) > 40 THEN concat(rtrim(t[:40]), '...[truncated]') ELSE t END AS text FROM (SELECT *, concat(template, chr(10), message) AS t FROM cands)"),
    "retrieval_outside": ("cands", f", top AS (SELECT * FROM cands ORDER BY {_RANKED} LIMIT 20) SELECT template, count(*) AS events, round(min(template_burst_score), 5) AS lowest_burst FROM cands WHERE event_id NOT IN (SELECT event_id FROM top) AND template IN (SELECT template FROM top) GROUP BY template"),
    "region_coverage": ("incidents anoms", """, r AS (SELECT *, row_number() OVER (ORDER BY block_id, start_order) % 3 <> 0 AS selected FROM incidents), h AS (SELECT a.event_id, bool_or(selected) AS selected FROM anoms a JOIN r ON a.block_id = r.block_id AND a.event_order BETWEEN interval_start AND interval_end GROUP BY 1)
SELECT count(*) AS anomalies, CAST(count_if(selected) AS BIGINT) AS in_selected, CAST(count_if(NOT selected) AS BIGINT) AS in_ignored FROM anoms LEFT JOIN h USING (event_id)"""),
    "stream_half": ("stream", "SELECT CAST(sum(b) AS BIGINT) AS rows, CAST(count_if(b > 0) AS BIGINT) AS blocks, CAST(count_if(b = 0) AS BIGINT) AS only_first FROM (SELECT block_id, count_if(i >= n / 2) AS b FROM stream GROUP BY 1)"),
    "packet_page": ("cands", f"SELECT rank, event_id FROM (SELECT event_id, row_number() OVER (ORDER BY template_count_deviation_score DESC, {_RANKED}) AS rank FROM cands) WHERE rank BETWEEN 11 AND 20"),
}
