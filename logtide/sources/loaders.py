"""Raw and structured log files as records, with explicit schemas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = ("event_order", "event_id", "ts", "message", "label", "template", "source", "block_id")
#: Files that a source is read from.
FILES = {"bgl": ("BGL_labeled.csv", "BGL.log"), "linux2k": ("lnx.txt", "linux2k.log"), "hdfs100k": ("HDFS_100k.log_structured.csv", "anomaly_label.csv"), "hdfs2k": ("HDFS_2k.log_structured.csv", "HDFS_2k.log"), "openstack2k": ("OpenStack_2k.log_structured.csv", "OpenStack_2k.log"), "thunderbird": ("Thunderbird_2k.log_structured.csv", "Thunderbird_2k.log")}


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, line_number`` (1-based, physical, blank lines counted) of one text file.

    Numbers come from byte-ordered splits: rows a split, summed over the splits
    before it, so no task reads the whole file.
    """
    numbered = spark.read.text(path).rdd.zipWithIndex().map(lambda x: (x[0][0], x[1] + 1))
    return spark.createDataFrame(numbered, "line string, line_number long")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")


def blank_to_null(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _records(df: DataFrame, source: str) -> DataFrame:
    kinds = {"event_order": "long", "event_id": "long", "ts": "timestamp_ntz", "message": "string", "label": "int", "template": "string", "block_id": "string"}
    have = [F.col(c).cast(k).alias(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()]
    return df.select(*have, F.lit(source).alias("source")).select(*RECORD)


def bgl_csv(spark: SparkSession, path: str) -> DataFrame:
    x = csv(spark, path, "id long, datetime string, log string, alert int, alert_type string, template string, block_id string, source_line string")
    return _records(x.withColumn("ts", F.expr("try_cast(datetime as timestamp_ntz)")).withColumn("message", F.trim("log")).withColumn("template", blank_to_null("template")).withColumn("block_id", blank_to_null("block_id")).withColumnsRenamed({"id": "event_id", "alert": "label"}).withColumn("event_order", F.col("event_id")), "bgl")


def bgl_lines(numbered: DataFrame) -> DataFrame:
    """Canonical parse of ``(-|TAG) EPOCH DATE REST``; lines with fewer than three parts are dropped, and without a REST the last part is the message."""
    parts = F.split(F.trim("line"), r"\s+", 4)
    x = numbered.withColumn("p", parts).where(F.size("p") >= 3)
    return x.select(F.col("line_number").alias("event_id"), F.col("line_number").alias("event_order"), F.when(F.col("p")[0] == "-", 0).otherwise(1).alias("label"), F.when(F.col("p")[1].rlike(r"^\d+$"), F.timestamp_seconds(F.expr("try_cast(p[1] as bigint)"))).alias("ts"), F.element_at("p", -1).alias("message"))


def bgl(spark: SparkSession, folder: str) -> DataFrame:
    if _exists(spark, f"{folder}/{FILES['bgl'][0]}"):
        return bgl_csv(spark, f"{folder}/{FILES['bgl'][0]}")
    return _records(bgl_lines(lines(spark, f"{folder}/{FILES['bgl'][1]}")), "bgl")


def linux2k(spark: SparkSession, folder: str) -> DataFrame:
    name = next((n for n in FILES["linux2k"] if _exists(spark, f"{folder}/{n}")), FILES["linux2k"][1])
    tokens = F.split(F.trim("line"), r"\s+")
    x = lines(spark, f"{folder}/{name}").where("trim(line) <> '' and not startswith(trim(line), '[page:')").withColumn("t", tokens).where(F.size("t") >= 4)
    ts = F.try_to_timestamp(F.concat(F.lit("1900 "), F.array_join(F.slice("t", 1, 3), " ")), F.lit("yyyy MMM d HH:mm:ss"))
    return _records(x.select(F.col("line_number").alias("event_id"), F.col("line_number").alias("event_order"), ts.alias("ts"), F.array_join(F.slice("t", F.lit(4), F.size("t")), " ").alias("message")), "linux2k")


def _structured(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    return csv(spark, path, f"LineId long, {extra}Date string, Time string, Pid string, Level string, Component string, Content string, EventId string, EventTemplate string")


def hdfs100k(spark: SparkSession, folder: str) -> DataFrame:
    """Structured lines, left-joined to the labels of their blocks by the first block id in the text."""
    x = _structured(spark, f"{folder}/{FILES['hdfs100k'][0]}").withColumn("block_id", F.nullif(F.regexp_extract("Content", r"(blk_-?\d+)", 1), F.lit("")))
    labels = csv(spark, f"{folder}/{FILES['hdfs100k'][1]}", "BlockId string, Label string").dropDuplicates(["BlockId"])
    x = x.join(labels, x["block_id"] == labels["BlockId"], "left").withColumn("label", F.when(F.col("Label") == "Anomaly", 1).when(F.col("Label").isNotNull(), 0))
    ts = F.try_to_timestamp(F.concat_ws(" ", F.lpad("Date", 6, "0"), F.lpad("Time", 6, "0")), F.lit("yyMMdd HHmmss"))
    return _records(x.select(F.col("LineId").alias("event_id"), F.col("LineId").alias("event_order"), ts.alias("ts"), F.col("Content").alias("message"), "label", blank_to_null("EventTemplate").alias("template"), "block_id"), "hdfs100k")


def _raw(spark: SparkSession, path: str, source: str) -> DataFrame:
    return _records(lines(spark, path).where("trim(line) <> ''").select(F.col("line_number").alias("event_id"), F.col("line_number").alias("event_order"), F.trim("line").alias("message")), source)


def hdfs2k(spark: SparkSession, folder: str) -> DataFrame:
    if not _exists(spark, f"{folder}/{FILES['hdfs2k'][0]}"):
        return _raw(spark, f"{folder}/{FILES['hdfs2k'][1]}", "hdfs2k")
    ts = F.try_to_timestamp(F.concat_ws(" ", F.lpad("Date", 6, "0"), F.lpad("Time", 6, "0")), F.lit("yyMMdd HHmmss"))
    return _records(_structured(spark, f"{folder}/{FILES['hdfs2k'][0]}").select(F.col("LineId").alias("event_id"), F.col("LineId").alias("event_order"), ts.alias("ts"), F.col("Content").alias("message"), blank_to_null("EventTemplate").alias("template")), "hdfs2k")


def openstack2k(spark: SparkSession, folder: str) -> DataFrame:
    if not _exists(spark, f"{folder}/{FILES['openstack2k'][0]}"):
        return _raw(spark, f"{folder}/{FILES['openstack2k'][1]}", "openstack2k")
    x = _structured(spark, f"{folder}/{FILES['openstack2k'][0]}", "Logrecord string, ")
    return _records(x.select(F.col("LineId").alias("event_id"), F.col("LineId").alias("event_order"), F.expr("try_cast(concat(Date, ' ', Time) as timestamp_ntz)").alias("ts"), F.col("Content").alias("message"), blank_to_null("EventTemplate").alias("template")), "openstack2k")


def thunderbird(spark: SparkSession, folder: str) -> DataFrame:
    label = lambda c: F.when(F.trim(c) == "", F.lit(None)).when(F.trim(c) == "-", 0).when(F.col(c).isNotNull(), 1)
    if not _exists(spark, f"{folder}/{FILES['thunderbird'][0]}"):
        x = lines(spark, f"{folder}/{FILES['thunderbird'][1]}").where("trim(line) <> ''").withColumn("p", F.split(F.trim("line"), r"\s+", 9)).where(F.size("p") == 9).select("line_number", F.col("p")[0].alias("Label"), F.col("p")[1].alias("Timestamp"), F.col("p")[8].alias("Content"), F.lit(None).cast("string").alias("EventTemplate"))
    else:
        x = csv(spark, f"{folder}/{FILES['thunderbird'][0]}", "LineId long, Label string, Timestamp string, User string, Location string, Component string, PID string, Content string, EventId string, EventTemplate string").withColumnRenamed("LineId", "line_number")
    ts = F.when(F.col("Timestamp").rlike(r"^\d+$"), F.timestamp_seconds(F.expr("try_cast(Timestamp as bigint)")))
    return _records(x.select(F.col("line_number").alias("event_id"), F.col("line_number").alias("event_order"), ts.alias("ts"), F.col("Content").alias("message"), label("Label").alias("label"), blank_to_null("EventTemplate").alias("template")), "thunderbird")


LOADERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (bgl, linux2k, hdfs100k, hdfs2k, openstack2k, thunderbird)}


def load_logs(spark: SparkSession, dataset: str, folder: str) -> DataFrame:
    if dataset not in LOADERS:
        raise ValueError(f"unknown dataset: {dataset}")
    return LOADERS[dataset](spark, folder)


def spread_starts(blocks: list[tuple[int, int]], k: int) -> list[int]:
    """Choose k of (block, anomalies) evenly by place: round(i * last / (k - 1)), halves to even."""
    order = [b for b, _ in sorted(blocks)]
    if k <= 0 or not order:
        return []
    if k == 1:
        return order[:1]
    return sorted({order[round(i * (len(order) - 1) / (k - 1))] for i in range(min(k, len(order)))})


def multi_block_sample(numbered: DataFrame, starts: list[int], size: int) -> DataFrame:
    """Rows of equal ranges (few, so broadcast), numbered anew by range and line."""
    spark = numbered.sparkSession
    ranges = F.broadcast(spark.createDataFrame([(i, s, s + size - 1) for i, s in enumerate(starts)], "range_id long, lo long, hi long"))
    x = numbered.join(ranges, F.col("line_number").between(F.col("lo"), F.col("hi")))
    from pyspark.sql import Window

    return x.withColumn("row_id", F.col("range_id") * size + F.row_number().over(Window.partitionBy("range_id").orderBy("line_number"))).drop("lo", "hi")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; a line that is no JSON object of the schema stops the read and is named."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
