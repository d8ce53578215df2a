"""The registered queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import candidates as K
from ..operators import extremes as X
from ..operators import incidents as I
from ..operators import metrics as M
from ..operators import stream as S
from ..operators import windows as W
from ..sources.adapters import events_as_logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and integers as longs, so that results compare across engines."""
    kinds = dict(df.dtypes)
    return df.select(*(F.round(F.col(c), digits).alias(c) if k == "double" else F.col(c).cast("long").alias(c) if k == "int" else F.col(c) for c, k in kinds.items()))


def logs(spark, d):
    return events_as_logs(spark, d)


def stream(spark, d):
    return S.novelty(*S.split_history(logs(spark, d)))


def members(spark, d):
    return W.count_windows(stream(spark, d))


def features(spark, d):
    return W.window_features(members(spark, d))


def flagged(spark, d):
    return X.ensemble(X.gev_scores(features(spark, d)))


def event_table(spark, d):
    own = features(spark, d)
    return K.event_candidates(members(spark, d), X.ensemble(X.gev_scores(own)).select("window_id", "is_suspicious", "max_excess", "max_score").join(own.drop("window_label", "num_anomalous"), "window_id"))


def scored_events(spark, d):
    """The stream with the unseen-or-new run in its block that holds each row, and bigram surprise; its position orders it."""
    s = stream(spark, d).withColumn("pos", F.col("i"))
    runs = X.burst_runs(s, "block_id").select("event_id", F.col("burst").cast("double").alias("template_burst_score"))
    return K.markov_surprise(s, 2).join(runs, "event_id")


@query
def template_counts(spark, d):
    return S.template_counts(logs(spark, d))


@query
def mask_messages(spark, d):
    return logs(spark, d).select("event_id", S.mask(F.col("message")).alias("masked"))


@query
def novelty_annotate(spark, d):
    return rounded(stream(spark, d).select("event_id", "template", "historical_count", "unseen", "rare", "is_new", "rarity_score", "novelty_score"))


@query
def count_windows(spark, d):
    return W.count_windows(S.split_history(logs(spark, d))[1]).select("window_id", "event_id")


@query
def time_windows(spark, d):
    m = W.time_windows(S.split_history(logs(spark, d))[1], 6.0, 3.0)
    return m.groupBy("window_id").agg(F.count("*").alias("num_records"), F.min("event_order").alias("first_order"), F.max("event_order").alias("last_order"))


@query
def group_windows(spark, d):
    return W.group_windows(logs(spark, d))


@query
def window_features(spark, d):
    return rounded(features(spark, d))


@query
def window_ground_truth(spark, d):
    return rounded(W.ground_truth(members(spark, d)))


@query
def gev_threshold(spark, d):
    return rounded(X.gev_thresholds(X.long_statistics(features(spark, d))).select("statistic", "n", "l1", "l2", "t3", "threshold"), 5)


@query
def gev_scored_windows(spark, d):
    return rounded(X.gev_scores(features(spark, d)).select("window_id", "statistic", "value", "threshold", "is_suspicious"), 5)


@query
def gev_ensemble_or(spark, d):
    return rounded(flagged(spark, d).select("window_id", "is_suspicious", "num_triggered", "triggered", "max_excess"), 5)


@query
def post_gev_eval(spark, d):
    return rounded(X.evaluate_windows(flagged(spark, d), members(spark, d)))


@query
def order_stat_threshold(spark, d):
    return rounded(X.order_statistic(stream(spark, d), "novelty_score", 0.95))


@query
def exceedances(spark, d):
    s = stream(spark, d)
    u = F.broadcast(X.order_statistic(s, "novelty_score", 0.95))
    return rounded(W.count_windows(s).crossJoin(u.select("u")).groupBy("window_id").agg(F.count_if(F.col("novelty_score") > F.col("u")).alias("num_exceedances"), F.max("novelty_score").alias("max_score")))


@query
def burst_runs(spark, d):
    return rounded(X.burst_runs(members(spark, d)).select("window_id", "event_id", "burst"))


@query
def past_z(spark, d):
    t = W.time_windows(logs(spark, d), 6.0, 6.0).groupBy("window_id").agg(F.count("*").alias("num_records"))
    return rounded(K.past_z(t), 5)


@query
def template_deviation(spark, d):
    return rounded(K.template_deviation(members(spark, d)))


@query
def sequence_context(spark, d):
    return rounded(K.sequence_context(members(spark, d)).select("window_id", "event_id", *K.CONTEXT))


@query
def event_candidates(spark, d):
    """All features; those that come from the fitted law to fewer places."""
    fitted = ("max_window_gev_score", "max_window_gev_excess")
    return rounded(event_table(spark, d).drop("message").withColumns({c: F.round(c, 5) for c in fitted}), 8)


@query
def markov_bigram(spark, d):
    return rounded(K.markov_surprise(stream(spark, d).withColumn("pos", F.col("i")), 2).select("event_id", "surprise"))


@query
def markov_trigram(spark, d):
    return rounded(K.markov_surprise(stream(spark, d).withColumn("pos", F.col("i")), 3).select("event_id", "surprise"))


@query
def rank_topk_burst(spark, d):
    return rounded(K.top_events(event_table(spark, d), "burst", 100).select("rank", "event_id", "template", "score"))


@query
def rank_budget_metrics(spark, d):
    total = logs(spark, d).agg(F.count_if(F.col("label") == 1).alias("total"), F.count("*").alias("events"))
    return rounded(K.budget_metrics(event_table(spark, d), "novelty", (10, 50, 100, 500), total))


@query
def template_rollup(spark, d):
    t = K.top_events(event_table(spark, d), "deviation", 200).groupBy("template").agg(F.count("*").alias("events"), F.count_if(F.col("label") == 1).alias("positives"), F.min("event_id").alias("first_event"), F.min_by("message", "rank").alias("message"))
    return rounded(t.withColumn("precision", F.col("positives") / F.col("events")))


@query
def threshold_sweep(spark, d):
    c = event_table(spark, d)
    grid = F.broadcast(spark.createDataFrame([(float(t),) for t in (0, 1, 2, 3, 4, 5)], "threshold double"))
    return rounded(c.crossJoin(grid).where("template_burst_score >= threshold").groupBy("threshold").agg(F.count("*").alias("events"), F.count_if(F.col("label") == 1).alias("positives"), F.countDistinct("template").alias("templates")))


@query
def time_split(spark, d):
    return rounded(M.time_split(features(spark, d).withColumn("pos", F.col("window_id")), "window_id").groupBy("split").agg(F.count("*").alias("windows"), F.count_if(F.col("window_label") == 1).alias("positives")))


@query
def block_split(spark, d):
    return rounded(M.block_split(logs(spark, d)).groupBy("split", "block_id").agg(F.count("*").alias("events"), F.count_if(F.col("label") == 1).alias("positives")))


@query
def block_folds(spark, d):
    return rounded(M.block_folds(logs(spark, d)))


@query
def event_count_vocab(spark, d):
    """Counts of the ten commonest templates of the first half, by window."""
    m = members(spark, d)
    n = m.agg((F.max("window_id") + 1).alias("_n"))
    train = m.crossJoin(F.broadcast(n)).where("window_id < greatest(1, floor(_n * 0.5))")
    vocabulary = train.groupBy("template").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "template").limit(10)
    named = vocabulary.withColumn("slot", F.row_number().over(Window.orderBy(F.desc("total"), "template")) - 1).withColumn("feature", F.concat(F.lit("event_count__"), F.lpad(F.col("slot").cast("string"), 3, "0"), F.lit("__"), F.substring(F.sha1("template"), 1, 10)))
    return m.join(F.broadcast(named.select("template", "feature")), "template").groupBy("window_id", "feature").agg(F.count("*").alias("count"))


@query
def average_precision(spark, d):
    return rounded(M.average_precision(stream(spark, d).select("label", F.col("novelty_score").alias("score"))))


@query
def threshold_choice(spark, d):
    return rounded(M.choose_threshold(stream(spark, d).select("label", F.col("novelty_score").alias("score")), 0.1))


@query
def classifier_metrics(spark, d):
    return rounded(M.at_threshold(stream(spark, d).select("label", F.col("novelty_score").alias("score")), 0.5))


def _anomalies(spark, d):
    return logs(spark, d).where("label = 1")


@query
def gap_clusters(spark, d):
    return I.gap_clusters(_anomalies(spark, d), 100)


@query
def cluster_intervals(spark, d):
    return rounded(I.with_context(I.gap_clusters(_anomalies(spark, d), 100), I.block_bounds(logs(spark, d)), 50, 50))


@query
def cluster_grid(spark, d):
    a = _anomalies(spark, d).crossJoin(F.broadcast(spark.createDataFrame([(g,) for g in (5, 20, 50, 100, 200)], "gap int")))
    w = Window.partitionBy("gap", "block_id").orderBy("event_order")
    new = F.when(F.coalesce(F.col("event_order") - F.lag("event_order").over(w) > F.col("gap"), F.lit(True)), 1).otherwise(0)
    return rounded(a.withColumn("new", new).groupBy("gap").agg(F.sum("new").alias("clusters"), F.count("*").alias("anomalies")))


@query
def merge_intervals(spark, d):
    return I.merge_intervals(I.with_context(I.gap_clusters(_anomalies(spark, d), 20), I.block_bounds(logs(spark, d)), 50, 50))


def _seeds(spark, d):
    events = scored_events(spark, d)
    t = I.calibrate(events, ("template_burst_score", "novelty_score", "surprise"))
    return I.triggers(events, t).where("trigger_reasons <> ''")


@query
def calibrate_thresholds(spark, d):
    return rounded(I.calibrate(scored_events(spark, d), ("template_burst_score", "novelty_score", "surprise")), 5)


@query
def trigger_channels(spark, d):
    return _seeds(spark, d).groupBy("trigger_reasons").agg(F.count("*").alias("events"))


@query
def incident_buffer(spark, d):
    return rounded(I.incident_buffer(_seeds(spark, d)))


@query
def region_eval(spark, d):
    return rounded(I.evaluate_regions(I.incident_buffer(_seeds(spark, d)), logs(spark, d)))


@query
def detection_delay(spark, d):
    truth = I.with_context(I.gap_clusters(_anomalies(spark, d), 100), I.block_bounds(logs(spark, d)), 10, 10)
    return rounded(I.detection_delays(truth, I.incident_buffer(_seeds(spark, d))))


@query
def gap_summary(spark, d):
    w = Window.partitionBy("block_id").orderBy("event_order")
    g = _anomalies(spark, d).withColumn("gap", F.col("event_order") - F.lag("event_order").over(w)).where("gap is not null")
    return rounded(g.agg(F.avg("gap").alias("mean_gap"), F.median("gap").alias("median_gap"), F.max("gap").alias("max_gap"), F.avg((F.col("gap") <= 50).cast("double")).alias("share_50")))


@query
def dispersion(spark, d):
    n = int(spark.read.parquet(f"{d}/events.parquet").count())
    return rounded(I.dispersion(_anomalies(spark, d), n, 100))


@query
def topn_concentration(spark, d):
    c = I.gap_clusters(_anomalies(spark, d), 100)
    w = Window.orderBy(F.desc("anomalies"), "start_order")
    x = c.withColumn("rank", F.row_number().over(w)).withColumn("running", F.sum("anomalies").over(w)).crossJoin(c.agg(F.sum("anomalies").alias("total")))
    return rounded(x.where("rank <= 20").select("rank", "running", (F.col("running") / F.col("total")).alias("share")))


@query
def block_scan(spark, d):
    return rounded(logs(spark, d).groupBy(F.expr("event_order div 500").alias("block")).agg(F.count("*").alias("rows"), F.sum("label").alias("anomalies")))


@query
def prefix_sample(spark, d):
    return logs(spark, d).where("message is not null").orderBy("event_order").limit(500).select("event_id", "template", "label")


@query
def multi_block_sample(spark, d):
    """Every fourth range of 250 rows, numbered anew by range and row."""
    x = logs(spark, d).where("event_order div 250 % 4 = 1").withColumn("range_id", F.expr("event_order div 1000"))
    before = x.groupBy("range_id").agg(F.count("*").alias("c")).withColumn("base", F.sum("c").over(Window.orderBy("range_id")) - F.col("c")).drop("c")
    return x.join(F.broadcast(before), "range_id").withColumn("row_id", F.col("base") + F.row_number().over(Window.partitionBy("range_id").orderBy("event_order"))).select("row_id", "event_id", "range_id")


@query
def cosine_topk(spark, d):
    """The five nearest vectors to every fiftieth one; a stated query set against all rows."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    q = F.broadcast(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("e").alias("q")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    x = e.crossJoin(q).where("vec_id <> query_id").withColumn("cosine", dot("e", "q") / F.sqrt(dot("e", "e") * dot("q", "q")))
    x = x.select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")).cast("long")).where("rank <= 5")


# Terms looked for in a row's template and message, by group, and those of a failure.
TERMS = {
    "failure_terms": ("fail", "failed", "failure", "fatal", "error", "exception"),
    "communication_terms": ("socket", "connection", "link", "network", "control stream"),
    "filesystem_terms": ("mount", "read", "write", "filesystem", "file system", "io"),
    "hardware_terms": ("machine check", "corrected", "uncorrected", "memory", "processor", "hardware"),
}
FAILURE_TERMS = ("fail", "failed", "failure", "fatal", "error", "exception", "uncorrected", "severed")


@query
def keyword_semantics(spark, d):
    """The terms of each group that a row holds, comma-joined; whether it tells of a failure or of something corrected."""
    low = F.lower(F.concat_ws(" ", F.coalesce("template", F.lit("")), F.coalesce("message", F.lit(""))))
    found = lambda terms: F.array_join(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t)), ",")
    return logs(spark, d).select("event_id", *(found(t).alias(n) for n, t in TERMS.items()), (F.contains(low, F.lit("corrected")) & ~F.contains(low, F.lit("uncorrected"))).alias("explicitly_corrected"), (found(FAILURE_TERMS) != "").alias("failure_like_text"))


@query
def cluster_packets(spark, d):
    top = K.top_events(event_table(spark, d), "deviation", 200)
    packs = top.groupBy("template").agg(F.count("*").alias("events"), F.countDistinct("block_id").alias("blocks"), F.min("rank").alias("best_rank"), F.max("template_burst_score").alias("burst_max"), F.avg("template_burst_score").alias("burst_mean"), F.array_join(F.transform(F.slice(F.sort_array(F.collect_list("rank")), 1, 3), lambda r: r.cast("string")), ",").alias("best_ranks"))
    return rounded(packs.orderBy("best_rank", F.desc("events")).limit(20))


@query
def neighbor_examples(spark, d):
    """Ids of the two rows before and behind each anomaly in stream order, across blocks: an equality join on the dense position."""
    x = logs(spark, d)
    around = x.where("label = 1").select("event_id", F.explode(F.expr("transform(array(-2, -1, 1, 2), k -> struct(k as k, event_order + k as event_order))")).alias("n")).select("event_id", "n.k", "n.event_order")
    near = around.join(x.select("event_order", F.col("event_id").alias("other")), "event_order", "left")
    at = lambda k, name: F.max(F.when(F.col("k") == k, F.col("other"))).alias(name)
    return near.groupBy("event_id").agg(at(-1, "before_1"), at(-2, "before_2"), at(1, "behind_1"), at(2, "behind_2"))


@query
def same_template_examples(spark, d):
    w = Window.partitionBy("template").orderBy("event_order").rowsBetween(-3, -1)
    x = logs(spark, d).select("event_id", "label", F.array_join(F.transform(F.collect_list("event_id").over(w), lambda e: e.cast("string")), ",").alias("earlier"))
    return x.where("label = 1").drop("label")


@query
def resource_metrics(spark, d):
    """Latency and tokens of one review a user; p95 is the half-even order statistic."""
    r = spark.read.parquet(f"{d}/events.parquet").selectExpr("user_id as packet_id", "event_id", "cast(value * 10 as bigint) as latency_ms", "event_id % 7 = 0 as cache_hit")
    one = r.withColumn("nth", F.row_number().over(Window.partitionBy("packet_id").orderBy("event_id"))).where("nth = 1")
    fresh = one.where("not cache_hit").withColumn("k", F.row_number().over(Window.orderBy("latency_ms", "packet_id")) - 1)
    n = fresh.agg(F.count("*").alias("n"), F.avg("latency_ms").alias("mean_latency"))
    p95 = fresh.crossJoin(n).where("k = bround((n - 1) * 0.95D, 0)").agg(F.max("latency_ms").alias("p95_latency"))
    return rounded(one.agg(F.count("*").alias("packets"), F.count_if("cache_hit").alias("cache_hits"), F.sum("latency_ms").alias("total_ms")).crossJoin(n.select("mean_latency")).crossJoin(p95))


@query
def vote_agreement(spark, d):
    """Ten runs vote on each user: share, unanimity, majority."""
    v = spark.read.parquet(f"{d}/events.parquet").selectExpr("user_id as region_id", "case when value >= 60 then 1 else 0 end as vote")
    x = v.groupBy("region_id").agg(F.avg("vote").alias("positive_share"), F.count("*").alias("runs"))
    return rounded(x.selectExpr("region_id", "runs", "positive_share", "positive_share in (0D, 1D) as unanimous", "positive_share >= 0.5 as majority_positive", "greatest(positive_share, 1 - positive_share) as majority_share"))


@query
def population_summary(spark, d):
    """Positives and rate overall and by split, in one pass."""
    x = M.block_split(logs(spark, d)).rollup("split").agg(F.count("*").alias("rows"), F.sum("label").alias("positives"))
    return rounded(x.select(F.coalesce("split", F.lit("all")).alias("split"), "rows", "positives", (F.col("positives") / F.col("rows")).alias("rate")))


@query
def topn_sweep(spark, d):
    grid = F.broadcast(spark.createDataFrame([(k,) for k in (1, 10, 100, 500)], "n int"))
    x = K.top_events(event_table(spark, d), "burst_novelty", 500).join(grid, F.col("rank") <= F.col("n"))
    return rounded(x.groupBy("n").agg(F.count("*").alias("events"), F.count_if(F.col("label") == 1).alias("positives"), (F.count_if(F.col("label") == 1) / F.count("*")).alias("precision"), F.countDistinct("block_id").alias("blocks")))


@query
def label_free_regions(spark, d):
    """Intervals round gap clusters of the top 200 events by score; no label takes part in their making."""
    seeds = K.top_events(event_table(spark, d), "novelty", 200)
    return rounded(I.with_context(I.gap_clusters(seeds, 50), I.block_bounds(logs(spark, d)), 10, 10).drop("density"))


_PROFILE = ("template_burst_score", "template_count_deviation_score", "novelty_score", "rarity_score")


@query
def score_neighbors(spark, d):
    """The three events nearest by score profile (L1) to each of the five best; a stated query set against all rows."""
    c = event_table(spark, d)
    q = F.broadcast(K.top_events(c, "burst", 5).select(F.col("event_id").alias("query_id"), *(F.col(p).alias(f"q_{p}") for p in _PROFILE)))
    distance = sum((F.abs(F.col(p) - F.col(f"q_{p}")) for p in _PROFILE), F.lit(0.0))
    x = c.crossJoin(q).where("event_id <> query_id").select("query_id", "event_id", "event_order", F.round(distance, 6).alias("distance"))
    return rounded(x.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "event_order"))).where("rank <= 3").drop("event_order"))


@query
def lower_score_contrast(spark, d):
    """For each of the five best the three events with the highest score below its own."""
    c = event_table(spark, d)
    q = F.broadcast(K.top_events(c, "deviation", 5).select(F.col("event_id").alias("query_id"), F.col("score").alias("q")))
    x = c.crossJoin(q).where("template_count_deviation_score < q").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("template_count_deviation_score"), "event_order")))
    return rounded(x.where("rank <= 3").select("query_id", "event_id", "rank", F.col("template_count_deviation_score").alias("score")), 5)


@query
def llm_policy_summary(spark, d):
    """Policies over stand-in decisions that follow from ids."""
    from ..operators import packets as P

    c = event_table(spark, d)
    r = K.top_events(c, "burst", 100).selectExpr(
        "cast(rank as string) as packet_id", "event_id", "rank as selection_rank", "element_at(array('likely_anomaly', 'uncertain', 'likely_normal'), cast(event_id % 3 + 1 as int)) as review_decision",
        "element_at(array('inspect_event', 'collect_more_context', 'ignore'), cast(event_id % 3 + 1 as int)) as recommended_action", "cast(event_id % 101 as double) as triage_score", "0.5D as confidence",
    )
    return rounded(P.policy_summary(r, c, 40))


# Beyond SQL: stateful or iterative operators, checked in the tests.


@query
def drain_per_block(spark, d):
    """Templates mined in each block by a miner of its own."""
    from ..operators import parsing

    return parsing.mine(logs(spark, d), "block_id").drop("group_id")


@query
def pot_event_refine(spark, d):
    from ..operators import pot

    m = members(spark, d)
    found = pot.refine(m, "novelty_score", pot.global_pot(m, "novelty_score", 0.3))
    return found.withColumn("candidate_event_ids", F.array_join(F.transform("candidate_event_ids", lambda e: e.cast("string")), ","))


@query
def pot_per_window(spark, d):
    from ..operators import pot

    return rounded(pot.per_window_pot(members(spark, d), "rarity_score"))


_MODEL = ["novelty_score", "rarity_score", "max_template_count_in_window", "template_burst_score", "template_count_deviation_score", "local_sequence_context_score"]


def _model_rows(spark, d):
    c = event_table(spark, d)
    return M.block_split(c).select("event_id", "label", "split", *_MODEL)


@query
def logistic_scores(spark, d):
    from ..operators import models

    x = _model_rows(spark, d)
    return rounded(models.logistic_scores(x.where("split <> 'test'"), x, _MODEL).select("event_id", "score"))


@query
def pca_spe_scores(spark, d):
    from ..operators import models

    x = _model_rows(spark, d)
    return rounded(models.pca_scores(x.where("label = 0"), x, _MODEL, 3).select("event_id", "score"))


@query
def isolation_forest(spark, d):
    from ..operators import models

    x = _model_rows(spark, d)
    return rounded(models.isolation_forest_scores(x.where("label = 0"), x, _MODEL).select("event_id", "score"))


@query
def review_packets(spark, d):
    """Packets of the top events, reviewed by the offline stand-in, as flat rows."""
    from ..operators import packets as P

    top = K.top_events(event_table(spark, d), "burst", 50)
    done = P.review(P.render(P.event_packets(top, "events", "burst"), "Review:\n{{PACKET_JSON}}"), P.offline_reviewer)
    return done.select("packet_id", "request_sha256", "valid_json", "review_decision", "recommended_action", "confidence")
