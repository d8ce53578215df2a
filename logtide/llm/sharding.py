"""Sharding by global prefix sums of byte sizes: contiguous, balanced shards.

Documents are put in id order by range partitions. Each partition's total is
summed over the partitions before it (a row a partition), a running sum inside
the partition does the rest, and a document goes to the shard in whose equal
share of all bytes its middle byte lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``, a row for each row.

    ``size``: UTF-8 bytes and 1 (null text: 1; its checksum is that of no
    bytes). Shards hold consecutive documents in ascending id order (null ids
    first; rows that repeat an id by checksum and size); ``slot`` counts from 0
    in each. Sizes of two shards differ by less than two documents. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = C.own(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    # written once: the same rows must lie in the same partition for the totals and for the running sums
    ranged = C.materialize(rows.repartitionByRange(C.partitions(spark), "doc_id", "text_crc32", "size").withColumn("part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    all_before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    bases = totals.select("part", F.coalesce(F.sum("bytes").over(all_before), F.lit(0)).alias("byte_base"), F.coalesce(F.sum("rows").over(all_before), F.lit(0)).alias("row_base"), F.sum("bytes").over(everything).alias("total"))
    inside = Window.partitionBy("part").orderBy("doc_id", "text_crc32", "size")
    summed = ranged.select("*", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.row_number().over(inside).alias("nth"))
    placed = summed.join(F.broadcast(bases), "part")  # as many rows as range partitions
    placed = placed.withColumn("shard", F.expr(f"cast((2 * (byte_base + upto) - size) * {shards} div (2 * total) as int)")).withColumn("place", F.col("row_base") + F.col("nth") - 1)
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).cast("long").alias("slot"))
