"""From documents to packed training sequences, stage by stage.

Each stage takes what the one before kept and calls one operator; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm import common as C
from logtide.llm import mixing, packing, quality, secrets, simhash
from logtide.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier rejects go; null and empty texts go with them.

    Equal texts fare alike, whatever their ids; an empty table stays empty.
    """
    return quality.classify_quality(docs).where("quality_good").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, the first by id (nulls last); see ``simhash.similar_rows`` for odd rows.

    Sets of five words with a Jaccard likeness of 0.8 or more link; fingerprints
    find the bulk of a group. The row is chosen in its group, whatever ids rows
    of other groups have.
    """
    return simhash.similar_rows(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret's span becomes one mark; ``n_chars`` follows the text.

    A row stays a row, whatever its id or text repeats; null texts stay null
    with ``n_chars`` null, empty ones empty. An empty table stays empty.
    """
    C.session_batches(spark)
    clean = docs.withColumn("text", secrets.redacted(F.col("text"), vocabulary("word_bpe_49k.json")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks.

    Rows that repeat an id are taken equally often; null is a source of its own;
    a source without words (null and empty texts) is not taken. An empty table
    stays empty.
    """
    return mixing.mixed_copies(mixing.mix_sources(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every emitted copy's tokens in sequences of at most 2048.

    Each row is a document of its own, also where ids repeat or are null; a null
    or empty text is its end id alone. An empty table gives no rows.
    """
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), capacity=2048, gap="white")


STAGES = [("quality", keep_quality), ("near_copies", drop_near_copies), ("secrets", redact_secrets), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it."""
    docs = C.table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = C.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the classifier, the fingerprints or the tokenizer.
ORACLE_SQL = None
