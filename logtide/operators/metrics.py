"""Classifier metrics from scores, without sorting row by row: equal scores are counted first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def curve(scored: DataFrame) -> DataFrame:
    """A row for each distinct score: cumulative true and false positives at "score or more", precision and recall."""
    groups = scored.where(F.col("label").isin(0, 1) & F.col("score").isNotNull()).groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    w = Window.orderBy(F.desc("score"))
    both = groups.agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_n"))
    x = groups.withColumn("tp", F.sum("p").over(w)).withColumn("fp", F.sum("q").over(w)).crossJoin(F.broadcast(both))
    return x.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide(F.col("tp"), F.nullif(F.col("all_p"), F.lit(0))))


def average_precision(scored: DataFrame) -> DataFrame:
    """AP (step sum over distinct scores) and ROC-AUC (ties count half); null for a single class."""
    x = curve(scored)
    out = x.agg(F.sum(F.col("p") * F.col("precision")).alias("s"), F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2)).alias("a"), F.max("all_p").alias("positives"), F.max("all_n").alias("negatives"))
    return out.selectExpr("case when positives > 0 and negatives > 0 then s / positives end as average_precision", "case when positives > 0 and negatives > 0 then a / (positives * negatives) end as roc_auc", "positives", "negatives")


def choose_threshold(scored: DataFrame, least_recall: float) -> DataFrame:
    """Of the thresholds that keep the recall, the one with the best (precision, recall, threshold).

    Where none does, the 0.9 quantile of the scores, without precision and recall.
    """
    best = curve(scored).where(F.col("recall") >= least_recall).orderBy(F.desc("precision"), F.desc("recall"), F.desc("score")).limit(1)
    fallback = scored.where(F.col("score").isNotNull()).agg(F.percentile("score", 0.9).alias("fallback"))
    return fallback.join(best.select("score", "precision", "recall"), F.lit(True), "left").select(F.coalesce("score", "fallback").alias("threshold"), "precision", "recall")


def at_threshold(scored: DataFrame, threshold: float) -> DataFrame:
    hit = F.col("score") >= threshold
    c = scored.where(F.col("label").isin(0, 1)).agg(F.count_if(hit & (F.col("label") == 1)).alias("tp"), F.count_if(hit & (F.col("label") == 0)).alias("fp"), F.count_if(~hit & (F.col("label") == 1)).alias("fn"), F.count_if(~hit & (F.col("label") == 0)).alias("tn"))
    return c.selectExpr("*", "try_divide(tp, nullif(tp + fp, 0)) as precision", "try_divide(tp, nullif(tp + fn, 0)) as recall", "try_divide(2 * tp, nullif(2 * tp + fp + fn, 0)) as f1")


def time_split(rows: DataFrame, order: str, train: float = 0.5, validation: float = 0.25) -> DataFrame:
    """train / validation / test by position; ``rows`` has ``pos`` (0-based) by ``order``."""
    n = rows.agg(F.count("*").alias("_n"))
    cut = n.withColumn("_a", F.greatest(F.lit(1), F.floor(F.col("_n") * train))).withColumn("_b", F.greatest(F.col("_a") + 1, F.floor(F.col("_n") * (train + validation))))
    x = rows.crossJoin(F.broadcast(cut))
    return x.withColumn("split", F.when(F.col("pos") < F.col("_a"), "train").when(F.col("pos") < F.col("_b"), "validation").otherwise("test")).drop("_n", "_a", "_b")


def block_split(rows: DataFrame) -> DataFrame:
    """Blocks in first-seen order take train, validation, test in turn."""
    blocks = rows.groupBy("block_id").agg(F.min("event_order").alias("_first"))
    named = blocks.withColumn("_k", (F.row_number().over(Window.orderBy("_first")) - 1) % 3).select("block_id", F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), F.col("_k") + 1).alias("split"))
    return rows.join(named, "block_id")


def block_folds(rows: DataFrame) -> DataFrame:
    """Cross-validation folds: fold i tests positive block i (and normal block i mod m), validates on the next positive one, trains on the rest.

    ``fold, block_id, split`` for every pair of fold and block; no folds with fewer than three positive blocks.
    """
    blocks = rows.groupBy("block_id").agg(F.min("event_order").alias("_first"), F.max((F.col("label") == 1).cast("int")).alias("_pos"))
    w = Window.partitionBy("_pos").orderBy("_first")
    ranked = blocks.withColumn("_k", F.row_number().over(w) - 1)
    m = ranked.agg(F.sum("_pos").alias("_m"))
    folds = ranked.where("_pos = 1").select(F.col("_k").alias("fold"))
    x = ranked.crossJoin(F.broadcast(m)).where("_m >= 3").crossJoin(F.broadcast(folds))
    split = F.expr("case when _pos = 1 and _k = fold then 'test' when _pos = 0 and _k % _m = fold then 'test' when _pos = 1 and _k = (fold + 1) % _m then 'validation' else 'train' end")
    return x.select("fold", "block_id", split.alias("split"))
