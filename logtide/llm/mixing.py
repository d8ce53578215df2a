"""Mixing sources to target weights by repetition rates.

Only DataFrame functions: sizes are summed by source, the small table of
sources gets targets by window functions, and each document is emitted
floor(rate) times and once more with the rate's fraction as probability, by a
hash of its id and the seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Sources up to which their table is broadcast (a hundred bytes each).
BROADCAST_SOURCES = 50_000
_CHANCE_DIGITS = 13  # hexadecimal digits of the hash that make the uniform number (52 bits)


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources in code point order (null last) take the weights in turn and share
    the whole by weight. A target stops at ``most`` times its source's size;
    the excess is shared again by weight until none is above. That fixed point
    is reached at once: with the sources ordered by cap / weight, those that
    stop are a prefix, and the rest share what the prefix leaves.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    shared = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = shared.withColumn("level", left / heavy)
    free = F.col("level") * F.col("weight") < F.col("cap")
    # the level of the first source that does not stop holds for all behind it
    level = F.first(F.when(free, F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return levels.select("source", "source_size", F.coalesce(F.least("cap", level * F.col("weight")), "cap").alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``row`` (all columns of ``docs``, whatever their names) and ``mix_size, mix_source_size, mix_target, mix_copies``, a row for each row.

    ``mix_copies`` is how often the mix takes the document, at most
    ceil(``most``). Null texts have size 0; null is a source of its own. A
    source of size 0 has target 0 and is not taken. Rows that repeat an id
    share their chance. An empty table gives no rows.
    """
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").cast("string").alias("mix_id"), F.col(f"`{source_col}`").alias("mix_own"), word_count(F.col(f"`{text_col}`")).alias("mix_size")
    )
    by_source = rows.groupBy(F.col("mix_own").alias("source")).agg(F.sum("mix_size").alias("source_size"))
    by_source = C.materialize(by_source, "sources")  # a row a source; read for its size, its targets and the join
    few = by_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    targets = source_targets(by_source, weights, most).select(F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    chance = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce("mix_id", F.lit("null")))), 1, _CHANCE_DIGITS), 16, 10).cast("double") / F.lit(float(16**_CHANCE_DIGITS))
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    # few sources go to every executor; more are joined by shuffle, where Spark splits a hot source
    joined = rows.join(F.broadcast(targets) if few else targets, F.col("mix_own").eqNullSafe(F.col("mix_source")))
    copies = F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")
    return joined.select("row", "mix_size", "mix_source_size", "mix_target", copies.alias("mix_copies"))


def mixed_copies(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of ``mix_sources`` as often as it is taken, with its columns as they were."""
    return mixed.where("mix_copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))).alias("mix_nth")).select("row.*")
