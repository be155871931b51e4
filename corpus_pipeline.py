"""From raw documents to packed training sequences, one operator per stage.

Each stage takes what its predecessor kept and wrote. Toxic documents go, one document of each group
of near-duplicates stays, personal data is replaced by its kind, sources are repeated or thinned to
their target weights, and the documents are packed into sequences.

All stages but the last return the columns they get, whatever their names. Null and empty texts are not
toxic, are alike to none, hold nothing personal and add no words, and become one token each; a null
source is a source. Very long texts are read whole. Of equal rows, and of rows with one id and equal texts, one stays after
near-duplicates; ties between equal texts go to the smallest id, a null id last. An empty table goes through every
stage as an empty table. Without labels of both kinds no document is toxic.

The first two stages send whole texts to Python from a lazy result, so they leave the session with Arrow
batches of at most ``TEXT_ROWS`` rows; ``run`` puts its setting back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotativa.llm import mixing, near_dup, packing, pii, toxicity
from rotativa.llm.common import table
from rotativa.session import BATCH_ROWS, materialize, short_batches


# What the operators read; other columns travel under names that none of them uses.
READ = ("doc_id", "text", "source", "lang", "n_chars")
# An Arrow batch is held several times over, by an executor's JVM and by each of its Python workers.
TEXT_ROWS = 512


def aside(docs: DataFrame) -> DataFrame:
    """``docs`` with its other columns out of the way."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in READ else f"aside_{i}") for i, c in enumerate(docs.columns)])


def back(made: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` under their own names."""
    return made.select(*[F.col(c if c in READ else f"aside_{i}").alias(c) for i, c in enumerate(docs.columns)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark, TEXT_ROWS)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return back(toxicity.score_toxicity(aside(docs), labels).filter("predicted = 0"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark, TEXT_ROWS)
    return back(near_dup.keep_first(aside(docs)), docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    redacted = pii.redact(pii.find_pii(aside(docs)))
    return back(redacted.withColumn("n_chars", F.length("text").cast("bigint")), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return back(mixing.repeated(mixing.mix(aside(docs))), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.stored_pieces(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# A trained network and the packing plan cannot be written in SQL; tests/llm compares each stage with
# a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), spark.conf.get(BATCH_ROWS)
    try:
        for name, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    finally:
        spark.conf.set(BATCH_ROWS, before)
    return STAGES[-1][1](spark, docs, sf_dir)
