"""The window table that models are fitted on, its baselines, and summaries over settings, folds and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.adapters import UNKNOWN
from . import candidates as K
from . import metrics as M
from .extremes import ratio


def window_metadata(members: DataFrame) -> DataFrame:
    """First and last time of each window, its majority block (of equals the first seen) and its blocks, sorted."""
    per = members.where("block_id is not null").groupBy("window_id", "block_id").agg(F.count("*").alias("n"), F.min("event_order").alias("first"))
    blocks = per.groupBy("window_id").agg(F.max_by("block_id", F.struct("n", -F.col("first"))).alias("block_id"), F.array_join(F.sort_array(F.collect_list("block_id")).cast("array<string>"), ",").alias("block_ids"))
    times = members.groupBy("window_id").agg(F.min_by("ts", "event_order").alias("start_time"), F.max_by("ts", "event_order").alias("end_time"), F.count("*").alias("num_records"))
    return times.join(blocks, "window_id", "left")


def modelling_table(features: DataFrame, windows: DataFrame, train: float = 0.5, validation: float = 0.25) -> DataFrame:
    """A row for each scored window: its split by position, populations, label, GEV scores, ten features and the count's z-score.

    ``windows``: ``window_id, is_suspicious, max_score, max_excess``.
    """
    x = K.past_z(features).join(windows.select("window_id", "is_suspicious", "max_score", "max_excess"), "window_id").withColumn("pos", F.col("window_id"))
    x = M.time_split(x, "window_id", train, validation)
    flag = F.col("is_suspicious").cast("long")
    return x.select(
        "window_id", "split", F.lit(1).cast("long").alias("population_all_windows"), flag.alias("population_post_gev"), F.col("window_label").cast("long").alias("label"), ratio(F.col("num_anomalous"), F.col("num_labeled")).alias("anomaly_event_ratio"),
        F.col("max_score").alias("gev_score"), F.col("max_excess").alias("gev_excess"), F.col("num_records").cast("double").alias("log_count"), F.col("unique_templates").cast("double").alias("distinct_templates"), "template_entropy",
        "rare_template_ratio", "unseen_template_ratio", "new_template_ratio", F.col("mean_novelty_score").alias("mean_event_novelty_score"), F.col("past_z").alias("count_z_baseline"), flag.alias("gev_is_suspicious"),
    )


def population(table: DataFrame, name: str) -> DataFrame:
    """Rows of "all_windows" or "post_gev"."""
    return table.where(F.col(f"population_{name}") == 1)


def gev_baseline(table: DataFrame) -> DataFrame:
    """Confusion of the GEV flag over all windows ("all") and by split, in one pass."""
    flag, label = F.col("gev_is_suspicious") == 1, F.col("label")
    cells = table.rollup("split").agg(F.count_if(flag & (label == 1)).alias("tp"), F.count_if(flag & (label == 0)).alias("fp"), F.count_if(~flag & (label == 0)).alias("tn"), F.count_if(~flag & (label == 1)).alias("fn"), F.count("*").alias("windows"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return cells.select(F.coalesce("split", F.lit("all")).alias("split"), "tp", "fp", "tn", "fn", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), ratio(F.col("tp") + F.col("fp"), F.col("windows")).alias("forwarded_window_ratio"))


def overfitting_risk(table: DataFrame) -> DataFrame:
    """How far the post-GEV population is too small to fit on: high below 20 positives or 100 windows, medium below 50 or 300."""
    n = population(table, "post_gev").agg(F.count("*").alias("windows"), F.count_if(F.col("label") == 1).alias("positives"))
    return n.withColumn("level", F.when((F.col("positives") < 20) | (F.col("windows") < 100), "high").when((F.col("positives") < 50) | (F.col("windows") < 300), "medium").otherwise("low"))


def fold_metrics(scored: DataFrame, folds: DataFrame, threshold: float) -> DataFrame:
    """Confusion, precision and recall on each fold's test blocks; ``folds``: ``fold, block_id, split``."""
    test = scored.join(folds.where("split = 'test'").select("fold", "block_id"), "block_id")
    hit, label = F.col("score") >= threshold, F.col("label")
    cells = test.groupBy("fold").agg(F.count_if(hit & (label == 1)).alias("tp"), F.count_if(hit & (label == 0)).alias("fp"), F.count_if(~hit & (label == 1)).alias("fn"))
    return cells.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))


def fold_averages(per_fold: DataFrame) -> DataFrame:
    """Micro average from summed cells; macro mean and deviation over the folds that have a value."""
    out = per_fold.agg(
        F.count("*").alias("folds"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.avg("precision").alias("macro_precision"), F.stddev_pop("precision").alias("std_precision"), F.avg("recall").alias("macro_recall"), F.stddev_pop("recall").alias("std_recall"),
    )
    return out.withColumn("micro_precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("micro_recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))


def select_best(results: DataFrame) -> DataFrame:
    """The model with the highest validation precision, then recall, then F1 (missing ones last)."""
    return results.orderBy(F.desc_nulls_last("precision"), F.desc_nulls_last("recall"), F.desc_nulls_last("f1"), "model").limit(1)


def infer_totals(candidates: DataFrame) -> DataFrame:
    """What the candidates tell of the stream: its length by both conventions, and its anomalies."""
    return candidates.agg((F.max("event_order") + 1).alias("events_by_max"), (F.max("event_order") - F.min("event_order") + 1).alias("events_by_span"), F.coalesce(F.sum((F.col("label") == 1).cast("long")), F.lit(0)).alias("anomalies"))


def setting_score(precision: Column, recall: Column, load: Column) -> Column:
    """0.60 recall + 0.25 precision + 0.15 (1 - load); missing values count 0."""
    return 0.60 * F.coalesce(recall, F.lit(0.0)) + 0.25 * F.coalesce(precision, F.lit(0.0)) + 0.15 * (1 - F.coalesce(load, F.lit(0.0)))


def modes(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The commonest value of each key; of equals the first in code point order."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.max("n").alias("n"))
    return counts.join(best, [key, "n"]).groupBy(key, "n").agg(F.min(value).alias("mode"))


def cluster_summary(rows: DataFrame, cluster: str = "template", examples: int = 3) -> DataFrame:
    """Size, first row and up to three first messages of each cluster, largest first by ``size``."""
    w = Window.partitionBy(cluster).orderBy("event_order")
    first = rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= examples)
    told = first.groupBy(cluster).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_order", "message"))), lambda r: r["message"]), " | ").alias("examples"), F.min("event_order").alias("first_order"))
    return rows.groupBy(cluster).agg(F.count("*").alias("size")).join(told, cluster)


def event_text(mode: str) -> Column:
    """Text of an event: its template, its message, or both."""
    parts = {"template": ["template"], "message": ["message"], "both": ["template", "message"]}[mode]
    return F.concat_ws("\n", *(F.coalesce(F.col(c), F.lit("")) for c in parts))


def truncated(text: Column, most: int, mark: str = "...[truncated]") -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most)), F.lit(mark))).otherwise(text)


#: Label-free columns of a retrieval corpus.
CORPUS = ("event_id", "event_order", "block_id", "template", "message", "template_burst_score", "template_count_deviation_score", "novelty_score", "rarity_score", "local_sequence_context_score", "suspicious_window_count")


def retrieval_corpus(candidates: DataFrame, mode: str = "both") -> DataFrame:
    """Label-free rows with their text, one for each event and text."""
    return candidates.select(*CORPUS, event_text(mode).alias("text")).dropDuplicates(["event_id", "text"])


def outside(corpus: DataFrame, members: DataFrame) -> DataFrame:
    """Corpus rows that are no member of the packets that are asked for."""
    return corpus.join(members.select("event_id").distinct(), "event_id", "left_anti")


def region_decisions(regions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Regions with the decision of their packet (``packet_id`` ends in ``:`` and the region); without one: uncertain."""
    told = reviews.select(F.substring_index("packet_id", ":", -1).cast("long").alias("region_id"), "review_decision")
    return regions.join(told, "region_id", "left").withColumn("review_decision", F.coalesce("review_decision", F.lit("uncertain"))).withColumn("selected", F.col("review_decision") != "likely_normal")


def post_pot_evaluation(refined: DataFrame, logs: DataFrame) -> DataFrame:
    """Precision, recall and load of the distinct candidate events of refined windows, by the stream's own labels."""
    ids = refined.select(F.explode("candidate_event_ids").alias("event_id")).distinct().withColumn("hit", F.lit(True))
    x = logs.select("event_id", "label").join(ids, "event_id", "left")
    hit, label = F.coalesce("hit", F.lit(False)), F.col("label")
    cells = x.agg(F.count("*").alias("events"), F.count_if(hit).alias("candidates"), F.count_if(hit & (label == 1)).alias("tp"), F.count_if(label == 1).alias("anomalies"))
    p, r = ratio(F.col("tp"), F.col("candidates")), ratio(F.col("tp"), F.col("anomalies"))
    return cells.select("*", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), ratio(F.col("candidates"), F.col("events")).alias("load"))


def cluster_sizes(members: DataFrame) -> DataFrame:
    """Size of each template's cluster in each window."""
    named = members.withColumn("template", F.coalesce("template", F.lit(UNKNOWN)))
    return named.groupBy("window_id", "template").agg(F.count("*").alias("size"), F.collect_list("event_id").alias("event_ids"))


def cluster_size_pot(sizes: DataFrame, fit: dict) -> DataFrame:
    """Windows with their clusters above the POT threshold: how many, and the events in them."""
    hit = F.col("size") > fit["threshold_z"]
    events = F.flatten(F.collect_list(F.when(hit, F.col("event_ids"))))
    return sizes.groupBy("window_id").agg(F.count_if(F.col("size") > fit["threshold_u"]).alias("num_exceedances"), F.count_if(hit).alias("num_pot_anomalies"), F.max(hit).alias("has_pot_anomaly"), F.array_sort(events).alias("candidate_event_ids"))


def merged(windows: DataFrame, refined: DataFrame) -> DataFrame:
    """All windows, those that were refined with what was found."""
    return windows.join(refined, "window_id", "left").withColumn("pot_suspicious", F.coalesce("pot_suspicious", F.lit(False)))
