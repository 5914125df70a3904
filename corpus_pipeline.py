"""A training corpus from the documents table, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.bpe import n_tokens, public_vocabulary, round_trip
from tidemark.llm.common import document_table, written
from tidemark.llm.language import document_model, with_language
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.mixing import mixed_documents, mixture
from tidemark.llm.set_join import keep_one

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told clearly; those without a letter or with a narrow margin go.

    The model learns from the labelled ones among ``docs``.  Without any label
    no language is told, and all go.
    """
    return with_language(docs, document_model(docs)).where("not rejected").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the long lines that five or more share, but for the last of these."""
    kept = dedup_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8."""
    return keep_one(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's rows: a document as often as it is drawn, shuffled within its shards.

    A shard may span several tasks, so their number follows from the session and
    not from that of the shards.
    """
    drawn = mixture(mixed_documents(docs))
    return drawn.repartitionByRange("shard", "position").sortWithinPartitions("shard", "position").select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed unsigned 32-bit) of every text, and whether they decode to it."""
    code = round_trip(spark, public_vocabulary())
    coded = docs.select(*COLUMNS, code(F.col("text")).alias("coded"))
    same = F.col("coded.decoded") == F.coalesce("text", F.lit("")).cast("binary")
    ids = F.col("coded.ids")
    return coded.select(*COLUMNS, ids.alias("token_ids"), n_tokens(ids).alias("n_tokens"), same.alias("decodes"))


STAGES = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixture", mix_sources),
    ("tokens", encode_tokens),
]

#: No stage but the second is expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = document_table(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
