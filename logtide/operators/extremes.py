"""GEV and threshold scoring of windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extremes import gev_from_moments

ENSEMBLE = ("unique_templates", "template_entropy", "rare_template_ratio", "unseen_template_ratio")


def long_statistics(features: DataFrame, names: tuple[str, ...] = ENSEMBLE) -> DataFrame:
    """``window_id, statistic, value``."""
    pairs = ", ".join(f"'{n}', cast({n} as double)" for n in names)
    return features.selectExpr("window_id", "window_label", "num_anomalous", f"stack({len(names)}, {pairs}) as (statistic, value)")


def l_moments(values: DataFrame) -> DataFrame:
    """L-moments of each statistic's values.

    Equal values are counted first; ranks then come from cumulative counts over
    the distinct values, so windows are never sorted one by one.
    """
    distinct = values.groupBy("statistic", "value").agg(F.count("*").alias("m"))
    before = Window.partitionBy("statistic").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = distinct.withColumn("c", F.coalesce(F.sum("m").over(before), F.lit(0)).cast("double")).withColumn("m", F.col("m").cast("double"))
    # sums of (r - 1) and (r - 1)(r - 2) over the ranks c + 1 .. c + m
    first = F.col("m") * F.col("c") + F.col("m") * (F.col("m") - 1) / 2
    squares = F.expr("m * c * c + 2 * c * (m * (m - 1) / 2) + (m - 1) * m * (2 * m - 1) / 6")
    sums = ranked.groupBy("statistic").agg(F.sum("m").alias("n"), F.sum(F.col("value") * F.col("m")).alias("s0"), F.sum(F.col("value") * first).alias("s1"), F.sum(F.col("value") * (squares - first)).alias("s2"))
    b = sums.where("n >= 3").selectExpr("statistic", "n", "s0 / n as b0", "s1 / (n * (n - 1)) as b1", "s2 / (n * (n - 1) * (n - 2)) as b2")
    return b.selectExpr("statistic", "cast(n as bigint) as n", "b0 as l1", "2 * b1 - b0 as l2", "try_divide(6 * b2 - 6 * b1 + b0, nullif(2 * b1 - b0, 0)) as t3")


def gev_thresholds(values: DataFrame, alpha: float = 0.9) -> DataFrame:
    """One row a statistic: its fit and upper quantile. A row a statistic visits the driver for the gamma function."""
    spark = values.sparkSession
    rows = []
    for r in l_moments(values).collect():
        if r.l2 and r.l2 > 0:
            shape, loc, scale, threshold = gev_from_moments(r.l1, r.l2, r.t3, alpha)
            rows.append((r.statistic, r.n, r.l1, r.l2, r.t3, shape, loc, scale, threshold))
    return spark.createDataFrame(rows, "statistic string, n long, l1 double, l2 double, t3 double, shape double, loc double, scale double, threshold double")


def gev_scores(features: DataFrame, names: tuple[str, ...] = ENSEMBLE, alpha: float = 0.9) -> DataFrame:
    """``window_id, statistic, value, threshold, is_suspicious`` (strictly above). A statistic that can't be fitted flags nothing."""
    values = long_statistics(features, names)
    return values.join(F.broadcast(gev_thresholds(values, alpha).select("statistic", "threshold")), "statistic", "left").withColumn("is_suspicious", F.coalesce(F.col("value") > F.col("threshold"), F.lit(False)))


def ensemble(scores: DataFrame) -> DataFrame:
    """OR rule: a window is suspicious if any member says so."""
    return scores.groupBy("window_id").agg(
        F.max("is_suspicious").alias("is_suspicious"), F.sum(F.col("is_suspicious").cast("long")).alias("num_triggered"), F.max(F.col("value") - F.col("threshold")).alias("max_excess"), F.max("value").alias("max_score"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("is_suspicious"), F.col("statistic")))), ",").alias("triggered"), F.max("window_label").alias("window_label"), F.max("num_anomalous").alias("num_anomalous"),
    )


def ratio(a, b):
    """a / b, null where b is 0."""
    return F.try_divide(a, F.nullif(b, F.lit(0)))


def evaluate_windows(windows: DataFrame, members: DataFrame) -> DataFrame:
    """Confusion of windows, precision, recall, F1, and how many distinct events are forwarded."""
    flag, label = F.col("is_suspicious"), F.col("window_label")
    cells = windows.agg(
        F.count_if(flag & (label == 1)).alias("tp"), F.count_if(flag & (label == 0)).alias("fp"), F.count_if(~flag & (label == 1)).alias("fn"), F.count_if(~flag & (label == 0)).alias("tn"), F.count("*").alias("windows"), F.count_if(flag).alias("suspicious")
    )
    per_event = members.select("window_id", "event_id", "label").join(windows.select("window_id", "is_suspicious"), "window_id").groupBy("event_id").agg(F.max("is_suspicious").alias("f"), F.max("label").alias("l"))
    events = per_event.agg(F.count("*").alias("events"), F.count_if("f").alias("forwarded"), F.count_if(F.col("l") == 1).alias("anomalies"), F.count_if(F.col("f") & (F.col("l") == 1)).alias("found"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = cells.crossJoin(events).withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("window_reduction", 1 - ratio(F.col("suspicious"), F.col("windows"))).withColumn("event_reduction", 1 - ratio(F.col("forwarded"), F.col("events"))).withColumn("event_recall", ratio(F.col("found"), F.col("anomalies")))


def order_statistic(values: DataFrame, column: str, q: float) -> DataFrame:
    """The lower-index order statistic sorted[int((n - 1) q)] as one row ``u, n``, from counts of distinct values."""
    distinct = values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("m"))
    upto = distinct.select(column, F.sum("m").over(Window.orderBy(column)).alias("upto"))
    n = distinct.agg(F.sum("m").alias("n"))
    return upto.crossJoin(F.broadcast(n)).where(F.col("upto") >= F.floor((F.col("n") - 1) * q) + 1).agg(F.min(column).alias("u"), F.max("n").alias("n"))


def burst_runs(members: DataFrame, key: str = "window_id") -> DataFrame:
    """Length of the unbroken unseen-or-new run in its window that holds each row, else 0."""
    w = Window.partitionBy(key).orderBy("event_order")
    on = (F.col("unseen") | F.col("is_new")).cast("int")
    island = members.withColumn("_on", on).withColumn("_island", F.sum(1 - F.col("_on")).over(w))
    return island.withColumn("burst", F.when(F.col("_on") == 1, F.sum("_on").over(Window.partitionBy(key, "_island"))).otherwise(0)).drop("_on", "_island")
