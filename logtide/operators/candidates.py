"""Event-level features, candidates and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.adapters import UNKNOWN


def past_z(windows: DataFrame, value: str = "num_records", order: str = "window_id") -> DataFrame:
    """z-score against all earlier windows; 0 with fewer than three or no spread."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    x = F.log1p(F.col(value).cast("double"))
    out = windows.withColumn("_n", F.count("*").over(w)).withColumn("_m", F.avg(x).over(w)).withColumn("_s", F.stddev_pop(x).over(w))
    return out.withColumn("past_z", F.when((F.col("_n") < 3) | (F.col("_s") < 1e-12), 0.0).otherwise((x - F.col("_m")) / F.col("_s"))).drop("_n", "_m", "_s")


def template_deviation(members: DataFrame) -> DataFrame:
    """Count of each (window, template) against that template's earlier windows."""
    counts = members.groupBy("window_id", "template").agg(F.count("*").alias("cnt"))
    w = Window.partitionBy("template").orderBy("window_id").rowsBetween(Window.unboundedPreceding, -1)
    past = counts.withColumn("seen_windows", F.count("*").over(w)).withColumn("past_mean", F.coalesce(F.avg("cnt").over(w), F.lit(0.0))).withColumn("_sum", F.sum("cnt").over(w)).withColumn("_squares", F.sum(F.col("cnt") * F.col("cnt")).over(w))
    # whole numbers: n * squares - sum ** 2, so that the same counts in another order have the same spread and their events tie
    whole = "cast(seen_windows as decimal(18, 0)) * cast(_squares as decimal(19, 0)) - cast(_sum as decimal(18, 0)) * cast(_sum as decimal(18, 0))"
    past = past.withColumn("past_std", F.coalesce(F.expr(f"sqrt(cast({whole} as double)) / nullif(seen_windows, 0)"), F.lit(0.0))).drop("_sum", "_squares")
    known = F.col("seen_windows") > 0
    z = F.when(known & (F.col("past_std") > 1e-12), (F.col("cnt") - F.col("past_mean")) / F.col("past_std")).otherwise(0.0)
    out = past.withColumn("past_z", z).withColumn("ratio", F.when(known, F.col("cnt") / (F.col("past_mean") + 1)).otherwise(F.col("cnt").cast("double")))
    out = out.withColumn("excess", F.when(known, F.col("cnt") - F.col("past_mean")).otherwise(F.col("cnt").cast("double")))
    return out.withColumn("deviation_score", F.when(known, F.greatest(F.lit(0.0), "past_z") + F.log1p(F.greatest(F.lit(0.0), "ratio"))).otherwise(F.log1p(F.col("cnt").cast("double"))))


#: The context features of ``sequence_context``, the composite score last.
CONTEXT = (
    "prev_event_novelty_score", "next_event_novelty_score", "neighbor_max_novelty_score", "neighbor_mean_novelty_score", "local_unseen_count_radius2", "local_new_template_count_radius2", "local_template_switch_count_radius2",
    "prev_template_same", "next_template_same", "relative_position_in_window", "distance_to_window_edge_ratio", "local_sequence_context_score",
)


def sequence_context(members: DataFrame) -> DataFrame:
    """``members`` with features of the up to five rows round each (itself and two to each side) in its window.

    Unseen and new rows are counted with the row itself, novelty of the
    neighbours without it. A null template counts as the unknown one.
    """
    w = Window.partitionBy("window_id").orderBy("event_order")
    near, before, behind = w.rowsBetween(-2, 2), w.rowsBetween(-2, -1), w.rowsBetween(1, 2)
    nov, template = F.col("novelty_score"), F.col("_t")
    x = members.withColumn("_t", F.coalesce("template", F.lit(UNKNOWN)))
    x = x.withColumn("_sw", F.when(F.lag("_t").over(w) != template, 1).otherwise(0)).withColumn("_pos", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy("window_id")))
    others = F.count("*").over(near) - 1
    beside = sum((F.coalesce(n, F.lit(0.0)) for n in (F.lag("novelty_score", 2).over(w), F.lag("novelty_score", 1).over(w), F.lead("novelty_score", 1).over(w), F.lead("novelty_score", 2).over(w))), F.lit(0.0))
    count = lambda c: F.sum(F.col(c).cast("long")).over(near)
    same = lambda other: F.coalesce((other == template).cast("long"), F.lit(0))
    last = F.col("_n") - 1
    x = x.select(
        *members.columns,
        F.coalesce(F.lag("novelty_score").over(w), F.lit(0.0)).alias("prev_event_novelty_score"),
        F.coalesce(F.lead("novelty_score").over(w), F.lit(0.0)).alias("next_event_novelty_score"),
        F.coalesce(F.greatest(F.max(nov).over(before), F.max(nov).over(behind)), F.lit(0.0)).alias("neighbor_max_novelty_score"),
        F.when(others > 0, beside / others).otherwise(0.0).alias("neighbor_mean_novelty_score"),
        count("unseen").alias("local_unseen_count_radius2"),
        count("is_new").alias("local_new_template_count_radius2"),
        F.sum("_sw").over(w.rowsBetween(-1, 2)).alias("local_template_switch_count_radius2"),
        same(F.lag("_t").over(w)).alias("prev_template_same"),
        same(F.lead("_t").over(w)).alias("next_template_same"),
        F.when(last > 0, F.col("_pos") / last).otherwise(0.0).alias("relative_position_in_window"),
        F.when(last > 0, F.least("_pos", last - F.col("_pos")) / (last / 2)).otherwise(0.0).alias("distance_to_window_edge_ratio"),
    )
    return x.withColumn("local_sequence_context_score", F.expr("neighbor_max_novelty_score + local_unseen_count_radius2 + local_new_template_count_radius2 + local_template_switch_count_radius2 + 1 - greatest(prev_template_same, next_template_same)"))


#: Columns of the suspicious windows that events take over: the column and the feature it becomes.
_OF_WINDOW = {
    "max_score": "max_window_gev_score", "max_excess": "max_window_gev_excess", "template_entropy": "max_window_template_entropy", "rare_template_ratio": "max_window_rare_template_ratio",
    "unseen_template_ratio": "max_window_unseen_template_ratio", "new_template_ratio": "max_window_new_template_ratio", "mean_novelty_score": "max_window_mean_event_novelty_score",
}
_OF_TEMPLATE = {
    "cnt": "max_template_count_in_window", "cnt_ratio": "max_template_ratio_in_window", "past_mean": "template_count_past_mean", "past_std": "template_count_past_std", "past_z": "template_count_past_z",
    "ratio": "template_count_past_ratio", "excess": "template_count_past_excess", "seen_windows": "template_count_seen_windows", "deviation_score": "template_count_deviation_score",
}
_OF_EVENT = {
    "novelty_score": "novelty_score", "rarity_score": "rarity_score", "historical_count_log": "historical_count_log", "unseen": "unseen_in_history", "rare": "historically_rare", "is_new": "is_new_template", "burst": "template_burst_score",
} | {c: c for c in CONTEXT}
EVENT_FEATURES = ("suspicious_window_count", *_OF_EVENT.values(), *_OF_WINDOW.values(), *_OF_TEMPLATE.values())


def event_candidates(members: DataFrame, windows: DataFrame) -> DataFrame:
    """One row for each event in a suspicious window, with ``EVENT_FEATURES``: maxima over its windows, 0 at least.

    ``windows``: ``window_id, is_suspicious``, the columns of ``_OF_WINDOW`` and ``num_records``.
    ``template_burst_score`` is the longest unbroken run of unseen or new rows that holds the event.
    """
    from .extremes import burst_runs

    named = members.withColumn("template", F.coalesce("template", F.lit(UNKNOWN)))
    flagged = named.join(windows.where("is_suspicious").select("window_id", "num_records", *_OF_WINDOW), "window_id")
    deviation = template_deviation(named.select("window_id", "template"))
    rows = sequence_context(burst_runs(flagged)).withColumn("historical_count_log", F.log1p("historical_count")).join(deviation, ["window_id", "template"]).withColumn("cnt_ratio", F.col("cnt") / F.col("num_records"))
    top = lambda c, name: F.greatest(F.lit(0.0), F.max(F.col(c).cast("double"))).alias(name)
    return rows.groupBy("event_id").agg(
        F.first("event_order").alias("event_order"), F.first("block_id").alias("block_id"), F.max_by("label", "window_id").alias("label"), F.first("template").alias("template"), F.first("message").alias("message"),
        F.count("*").alias("suspicious_window_count"), *(top(c, name) for c, name in (_OF_EVENT | _OF_WINDOW | _OF_TEMPLATE).items()),
    )


def markov_surprise(events: DataFrame, order: int = 2, alpha: float = 0.1) -> DataFrame:
    """-ln of the smoothed probability of each template after its context, from what precedes it in the whole stream.

    Contexts run inside a block; counts are global, in (block, order, id) order.
    Rows need ``pos``, that order as a number. The number of templates known
    before a row comes from first occurrences, one row a template.
    """
    block = Window.partitionBy("block_id").orderBy("pos")
    x = events
    for k in range(1, order):
        x = x.withColumn(f"_c{k}", F.lag("template", k).over(block))
    ctx = [f"_c{k}" for k in range(1, order)]
    full = F.lit(True)
    for c in ctx:
        full = full & F.col(c).isNotNull()
    past = lambda *keys: Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_cc", F.count("*").over(past(*ctx))).withColumn("_tc", F.count("*").over(past(*ctx, "template"))).withColumn("_full", full)
    firsts = events.groupBy("template").agg(F.min("pos").alias("pos")).select("pos", F.lit(1).alias("_first"))
    rank = firsts.withColumn("_v", F.row_number().over(Window.orderBy("pos")))
    spans = rank.select(F.col("pos").alias("_lo"), F.coalesce(F.lead("pos").over(Window.orderBy("pos")), F.lit(2**62)).alias("_hi"), "_v")
    marks = F.broadcast(spans.agg(F.sort_array(F.collect_list("_lo")).alias("_los")))  # a number for each template
    x = x.crossJoin(marks).withColumn("_v", F.greatest(F.lit(1), F.size(F.filter("_los", lambda p: p < F.col("pos")))))
    p = (F.col("_tc") + alpha) / (F.col("_cc") + alpha * F.col("_v"))
    return x.withColumn("surprise", F.when(F.col("_full"), -F.ln(F.greatest(p, F.lit(1e-12)))).otherwise(0.0)).drop("_cc", "_tc", "_full", "_los", "_v", *ctx)


_ORDER = ("template_burst_score", "template_count_deviation_score", "novelty_score", "rarity_score")
#: Ranking methods as score expressions over the candidate columns.
METHODS = {
    "burst": "template_burst_score", "deviation": "template_count_deviation_score", "novelty": "novelty_score", "rarity": "rarity_score", "past_z": "template_count_past_z", "context": "local_sequence_context_score",
    "markov_bigram": "markov_bigram_surprise", "markov_trigram": "markov_trigram_surprise", "burst_markov": "burst_norm + markov_norm",
    "burst_novelty": "burst_norm + novelty_norm", "burst_deviation": "burst_norm + deviation_norm", "burst_context": "burst_norm + context_norm",
}


def normalised(candidates: DataFrame) -> DataFrame:
    """Adds ``*_norm`` columns: the score over its maximum (0 where that is 0)."""
    pairs = {"burst": "template_burst_score", "deviation": "template_count_deviation_score", "novelty": "novelty_score", "context": "local_sequence_context_score"}
    if "markov_bigram_surprise" in candidates.columns:
        pairs["markov"] = "markov_bigram_surprise"
    tops = candidates.agg(*(F.max(c).alias(f"_{n}") for n, c in pairs.items()))
    out = candidates.crossJoin(F.broadcast(tops))
    return out.withColumns({f"{n}_norm": F.when(F.col(f"_{n}") > 0, F.col(c) / F.col(f"_{n}")).otherwise(0.0) for n, c in pairs.items()}).drop(*(f"_{n}" for n in pairs))


def with_markov(candidates: DataFrame) -> DataFrame:
    """Adds the surprise of each candidate after one and after two candidates before it, in candidate order."""
    x = candidates.withColumn("pos", F.col("event_order"))
    two = markov_surprise(x, 2).withColumnRenamed("surprise", "markov_bigram_surprise")
    return two.join(markov_surprise(x, 3).select("event_id", F.col("surprise").alias("markov_trigram_surprise")), "event_id").drop("pos")


def score(method: str) -> Column:
    return F.expr(METHODS[method])


def top_events(candidates: DataFrame, method: str, k: int) -> DataFrame:
    """The k best rows with their rank; ties by the other scores, then order and id. Only k rows are ever sorted whole."""
    keys = [F.desc("score"), *(F.desc(c) for c in _ORDER), F.asc("event_order"), F.asc("event_id")]
    best = normalised(candidates).withColumn("score", score(method)).orderBy(*keys).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*keys)))


def budget_metrics(candidates: DataFrame, method: str, ks: tuple[int, ...], total_anomalies: DataFrame) -> DataFrame:
    """Precision, recall and load at several budgets from one ranking; ``total_anomalies`` is one row ``total, events``."""
    ranked = top_events(candidates, method, max(ks))
    grid = F.broadcast(candidates.sparkSession.createDataFrame([(k,) for k in ks], "k int"))
    cut = ranked.join(grid, F.col("rank") <= F.col("k")).groupBy("k").agg(F.count("*").alias("selected"), F.count_if(F.col("label") == 1).alias("positives"), F.countDistinct("template").alias("templates"))
    out = cut.crossJoin(F.broadcast(total_anomalies))
    return out.select("k", "selected", "positives", "templates", (F.col("positives") / F.col("selected")).alias("precision"), F.try_divide(F.col("positives"), F.nullif(F.col("total"), F.lit(0))).alias("recall"), (F.col("selected") / F.col("events")).alias("load"))
