"""Gap clusters, intervals, regions and the incident buffer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gap_clusters(points: DataFrame, max_gap: int, keys: tuple[str, ...] = ("block_id",)) -> DataFrame:
    """Runs of points of a block with gaps of at most ``max_gap``, with ids in block order."""
    w = Window.partitionBy(*keys).orderBy("event_order", "event_id")
    run = points.withColumn("_run", F.sum(F.when(F.col("event_order") - F.lag("event_order").over(w) > max_gap, 1).otherwise(0)).over(w))
    return run.groupBy(*keys, "_run").agg(F.min("event_order").alias("start_order"), F.max("event_order").alias("end_order"), F.count("*").alias("events"), F.count_if(F.col("label") == 1).alias("anomalies"), F.countDistinct("template").alias("templates")).drop("_run")


def with_context(clusters: DataFrame, bounds: DataFrame, before: int, behind: int) -> DataFrame:
    """Intervals round the clusters, clamped to their block (``bounds``: a row a block)."""
    out = clusters.join(bounds, "block_id").withColumn("interval_start", F.greatest(F.col("start_order") - before, "block_start")).withColumn("interval_end", F.least(F.col("end_order") + behind, "block_end"))
    return out.withColumn("length", F.col("interval_end") - F.col("interval_start") + 1).withColumn("density", F.col("anomalies") / F.col("length")).drop("block_start", "block_end")


def block_bounds(logs: DataFrame) -> DataFrame:
    return logs.groupBy("block_id").agg(F.min("event_order").alias("block_start"), F.max("event_order").alias("block_end"))


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """Overlapping or adjacent closed intervals of a block as one."""
    w = Window.partitionBy("block_id").orderBy("interval_start", "interval_end")
    top = F.max("interval_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    run = intervals.withColumn("_new", F.when(F.col("interval_start") > top + 1, 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w))
    return run.groupBy("block_id", "_run").agg(F.min("interval_start").alias("interval_start"), F.max("interval_end").alias("interval_end")).drop("_run")


def covered(points: DataFrame, intervals: DataFrame, width: int = 1000) -> DataFrame:
    """Points that lie in an interval of their block (semi join).

    Intervals are cut at multiples of ``width``, so the join has an equality on
    (block, bin) and no pair of a point with an interval far away.
    """
    bins = intervals.select("block_id", "interval_start", "interval_end", F.explode(F.expr(f"sequence(interval_start div {width}, interval_end div {width})")).alias("_bin"))
    x = points.withColumn("_bin", F.expr(f"event_order div {width}"))
    on = (x["block_id"] == bins["block_id"]) & (x["_bin"] == bins["_bin"]) & x["event_order"].between(bins["interval_start"], bins["interval_end"])
    return x.join(bins, on, "left_semi").drop("_bin")


def evaluate_regions(intervals: DataFrame, logs: DataFrame) -> DataFrame:
    """Length, load, covered anomalies, recall, density and compression of a set of intervals."""
    merged = merge_intervals(intervals)
    size = merged.agg(F.count("*").alias("intervals"), F.coalesce(F.sum(F.expr("interval_end - interval_start + 1")), F.lit(0)).alias("length"))
    anomalies = logs.where("label = 1").select("event_id", "block_id", "event_order")
    hit = covered(anomalies, merged).agg(F.count("*").alias("covered"))
    total = logs.agg(F.count("*").alias("events"), F.count_if(F.col("label") == 1).alias("anomalies"))
    out = size.crossJoin(hit).crossJoin(total)
    return out.selectExpr("intervals", "length", "covered", "anomalies", "length / events as stream_load", "try_divide(covered, nullif(anomalies, 0)) as recall", "try_divide(covered, nullif(length, 0)) as density", "try_divide(covered, nullif(intervals, 0)) as compression")


def calibrate(events: DataFrame, columns: tuple[str, ...], fraction: float = 0.2, q: float = 0.98) -> DataFrame:
    """Exact linear quantiles of the first part of the stream (rows with ``pos``), as one row."""
    n = events.agg(F.count("*").alias("_n"))
    head = events.crossJoin(F.broadcast(n)).where(F.col("pos") < F.greatest(F.lit(1), F.floor(F.col("_n") * fraction)))
    return head.agg(*(F.percentile(c, F.lit(q)).alias(f"q_{c}") for c in columns))


CHANNELS = {"dense_template_burst": "template_burst_score", "dense_novelty": "novelty_score", "diversity_markov_bigram": "surprise"}


def triggers(events: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Rows with the names of the channels at or above their threshold, sorted; "" for none."""
    x = events.crossJoin(F.broadcast(thresholds))
    fired = F.array_compact(F.array(*(F.when(F.col(c) >= F.col(f"q_{c}"), F.lit(name)) for name, c in sorted(CHANNELS.items()))))
    return x.withColumn("trigger_reasons", F.array_join(fired, ",")).drop(*(f"q_{c}" for c in CHANNELS.values()))


def incident_buffer(seeds: DataFrame, max_gap: int = 50, close_after: int = 50, before: int = 10, behind: int = 10) -> DataFrame:
    """Incidents that the sequential open / extend / close machine makes, as islands: a block's incident goes on while the next seed is at most min(max_gap, close_after) away."""
    gap = min(max_gap, close_after)
    w = Window.partitionBy("block_id").orderBy("event_order", "event_id")
    run = seeds.withColumn("_run", F.sum(F.when(F.col("event_order") - F.lag("event_order").over(w) > gap, 1).otherwise(0)).over(w))
    out = run.groupBy("block_id", "_run").agg(
        F.min("event_order").alias("start_order"), F.max("event_order").alias("end_order"), F.count("*").alias("seed_events"), F.countDistinct("template").alias("templates"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("trigger_reasons", ","))))), ",").alias("trigger_reasons"), F.max("template_burst_score").alias("max_burst"), F.max("novelty_score").alias("max_novelty"),
    )
    return out.drop("_run").withColumn("interval_start", F.greatest(F.lit(0), F.col("start_order") - before)).withColumn("interval_end", F.col("end_order") + behind)


def detection_delays(truth: DataFrame, regions: DataFrame) -> DataFrame:
    """For each true cluster the start of the first region that overlaps it, less its own start; null if none does."""
    r = regions.select("block_id", "interval_start", "interval_end")
    hits = truth.alias("t").join(r.alias("r"), F.expr("t.block_id = r.block_id and r.interval_start <= t.interval_end and r.interval_end >= t.interval_start"), "left")
    return hits.groupBy("t.block_id", "t.start_order").agg((F.min("r.interval_start") - F.col("start_order")).alias("delay"))


def dispersion(points: DataFrame, total: int, bins: int) -> DataFrame:
    """Anomalies by equal bins of the stream, empty ones too: variance over mean, share of non-empty bins, largest."""
    width = max(1, total // bins)
    counts = points.groupBy(F.least(F.lit(bins - 1), F.expr(f"event_order div {width}")).alias("bin")).agg(F.count("*").alias("c"))
    every = points.sparkSession.range(bins).withColumnRenamed("id", "bin")
    x = every.join(counts, "bin", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return x.agg(F.lit(bins).alias("bins"), F.try_divide(F.var_pop("c"), F.nullif(F.avg("c"), F.lit(0.0))).alias("dispersion"), F.avg((F.col("c") > 0).cast("double")).alias("non_empty"), F.max("c").alias("largest"))
