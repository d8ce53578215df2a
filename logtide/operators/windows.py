"""Windows over the stream, kept flat: a membership frame and a feature frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.adapters import UNKNOWN


def count_windows(stream: DataFrame, size: int = 100, stride: int = 50) -> DataFrame:
    """Membership (``window_id``, the row's columns) of sliding count windows.

    ``stream`` has ``i`` (0-based) and ``n``. Windows start at 0, stride, ...
    while they fit; a tail window holds the last ``size`` rows if they are not
    all covered; fewer rows than ``size`` make one window. No shuffle: each row
    computes its windows.
    """
    if size <= 0 or stride <= 0:
        raise ValueError("size and stride must be positive")
    full = f"(case when n >= {size} then (n - {size}) div {stride} + 1 else 1 end)"
    lo = f"greatest(0L, cast(ceil((i - {size} + 1) / {stride}) as bigint))"
    hi = f"least(i div {stride}, {full} - 1)"
    tail = f"case when n > {size} and ({full} - 1) * {stride} + {size} < n and i >= n - {size} then array({full}) else cast(array() as array<bigint>) end"
    ids = F.expr(f"concat(case when {lo} <= {hi} then sequence({lo}, {hi}) else cast(array() as array<bigint>) end, {tail})")
    return stream.withColumn("window_id", F.explode(ids))


def time_windows(stream: DataFrame, hours: float, stride_hours: float) -> DataFrame:
    """Membership of time windows [start, start + hours), anchored at the first timestamp; ids number the non-empty ones."""
    d, t = int(hours * 3600), int(stride_hours * 3600)
    anchor = stream.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("_t0"))
    timed = stream.where("ts is not null").crossJoin(F.broadcast(anchor)).withColumn("_s", (F.unix_micros(F.col("ts").cast("timestamp")) - F.col("_t0")) / 1e6)
    raw = timed.withColumn("slot", F.explode(F.expr(f"sequence(greatest(0L, cast(floor((_s - {d}) / {t}) as bigint) + 1), cast(floor(_s / {t}) as bigint))")))
    slots = raw.select("slot").distinct()
    return raw.join(number(slots, "slot", "window_id"), "slot").drop("_t0", "_s")


def number(values: DataFrame, by: str, name: str) -> DataFrame:
    """A small distinct frame numbered from 0 by ``by``."""
    from pyspark.sql import Window

    return values.withColumn(name, (F.row_number().over(Window.orderBy(by)) - 1).cast("long"))


def group_windows(stream: DataFrame, key: str = "block_id") -> DataFrame:
    """One window a key, in order of first appearance, with cumulative offsets; null keys are dropped."""
    from pyspark.sql import Window

    groups = stream.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("num_records"), F.min("event_order").alias("_first"), F.max("event_order").alias("last_order"))
    w = Window.orderBy("_first")
    offsets = groups.withColumn("window_id", (F.row_number().over(w) - 1).cast("long")).withColumn("end_index", F.sum("num_records").over(w)).withColumn("start_index", F.col("end_index") - F.col("num_records"))
    return offsets.withColumnRenamed("_first", "first_order")


def ground_truth(members: DataFrame) -> DataFrame:
    """Label counts of each window; ``window_label`` is null where no row is labelled."""
    return members.groupBy("window_id").agg(
        F.count("*").alias("num_records"), F.count("label").alias("num_labeled"), F.coalesce(F.sum((F.col("label") == 1).cast("long")), F.lit(0)).alias("num_anomalous"), F.max("label").alias("window_label")
    )


def window_features(members: DataFrame) -> DataFrame:
    """The 21 features and the label counts of each window.

    Two levels: (window, template) first, which is combined before the
    shuffle, then the window.
    """
    w = members.withColumn("template", F.coalesce("template", F.lit(UNKNOWN)))
    per = w.groupBy("window_id", "template").agg(
        F.count("*").alias("c"), F.sum(F.col("is_new").cast("long")).alias("new"), F.sum(F.col("rare").cast("long")).alias("rare"), F.sum(F.col("unseen").cast("long")).alias("unseen"),
        F.max("novelty_score").alias("nmax"), F.sum("novelty_score").alias("nsum"), F.sum(F.col("novelty_score") * F.col("novelty_score")).alias("nsq"),
        F.max("rarity_score").alias("rmax"), F.sum("rarity_score").alias("rsum"), F.sum(F.col("rarity_score") * F.col("rarity_score")).alias("rsq"),
        F.min("event_order").alias("lo"), F.max("event_order").alias("hi"), F.sum((F.col("label") == 1).cast("long")).alias("anom"), F.count("label").alias("lab"), F.max("label").alias("ml"),
    )
    agg = per.groupBy("window_id").agg(
        F.sum("c").alias("num_records"), F.count("*").alias("unique_templates"), F.max("c").alias("max_cluster_size"), F.avg("c").alias("mean_cluster_size"), F.sum(F.col("c") * F.log2("c")).alias("clogc"),
        F.sum("new").alias("new_template_count"), F.sum("rare").alias("rare_template_count"), F.sum("unseen").alias("unseen_template_count"),
        F.max("nmax").alias("max_novelty_score"), F.sum("nsum").alias("nsum"), F.sum("nsq").alias("nsq"), F.max("rmax").alias("max_rarity_score"), F.sum("rsum").alias("rsum"), F.sum("rsq").alias("rsq"),
        F.min("lo").alias("first_order"), F.max("hi").alias("last_order"), F.coalesce(F.sum("anom"), F.lit(0)).alias("num_anomalous"), F.sum("lab").alias("num_labeled"), F.max("ml").alias("window_label"),
    )
    n = F.col("num_records")
    out = agg.select(
        "window_id", "num_records", "unique_templates", (F.col("unique_templates") / n).alias("unique_template_ratio"), (F.log2(n) - F.col("clogc") / n).alias("template_entropy"),
        "max_cluster_size", "mean_cluster_size", (F.col("max_cluster_size") / n).alias("max_cluster_ratio"),
        "new_template_count", (F.col("new_template_count") / n).alias("new_template_ratio"), "rare_template_count", (F.col("rare_template_count") / n).alias("rare_template_ratio"),
        "unseen_template_count", (F.col("unseen_template_count") / n).alias("unseen_template_ratio"),
        "max_novelty_score", (F.col("nsum") / n).alias("mean_novelty_score"), F.greatest(F.lit(0.0), F.col("nsq") / n - F.pow(F.col("nsum") / n, 2)).alias("var_novelty_score"),
        "max_rarity_score", (F.col("rsum") / n).alias("mean_rarity_score"), F.greatest(F.lit(0.0), F.col("rsq") / n - F.pow(F.col("rsum") / n, 2)).alias("var_rarity_score"),
        "first_order", "last_order", "num_labeled", "num_anomalous", "window_label",
    )
    return out.withColumn("novelty_magnitude_score", F.expr("max_cluster_ratio + unique_template_ratio + rare_template_ratio + new_template_ratio"))
