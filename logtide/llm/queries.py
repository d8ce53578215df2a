"""One query for each operator, over the whole of its table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import metric_join, mixing, order_minhash, packing, quality, secrets, sharding, simhash, substring_dedup, token_files


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; the same on every executor, as the package is installed there."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 50 words."""
    found = substring_dedup.substring_dedup(C.table(spark, sf_dir, "documents"), length=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.size("spans").alias("n_spans"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of 3 words, 64 bits, 3 of them may differ."""
    found = simhash.simhash_components(C.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 5, 2, 1 in turn; no source above 3 times its size."""
    mixed = mixing.mix_sources(C.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("row.doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base patterns, and values in credential context that take 10 ** 8 guesses."""
    found = secrets.scan_secrets(C.table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda s: s["kind"] != "guess")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"), count("guess"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids, end id 0, through files in the shared folder."""
    import uuid

    path = f"{C.shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(C.table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), gap="space")
    C.written(spark, path)
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 contiguous shards of equal bytes."""
    found = sharding.shard_by_bytes(C.table(spark, sf_dir, "documents"), shards=16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, end id 0."""
    return packing.pack_documents(C.table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=2048, gap="white")


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 sketches of 2 k-mers of 6 code points each."""
    return order_minhash.order_minhash(C.table(spark, sf_dir, "documents"))


def op9_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine 0.98 within a label."""
    return metric_join.metric_range_join(C.table(spark, sf_dir, "embeddings"), threshold=0.98)


def op10_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior of the votes, the scorer's probability of good and the decision for every document."""
    found = quality.classify_quality(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", F.round("quality_weak", 6).alias("weak_label"), F.round("quality_score", 6).alias("score"), F.col("quality_good").alias("keep"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_rlz_dedup, op2_simhash, op3_mix_sources, op4_secret_scan, op5_token_files, op6_shards, op7_pack, op8_order_minhash, op9_metric_join, op10_weak_quality, pipeline)
    return {f.__name__: f for f in named}
