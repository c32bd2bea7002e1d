"""A training-corpus pipeline: toxicity, exact dedup, near-dedup, secret scan, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns of
``documents`` (and any further ones that came in); the last returns one row per packed piece.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.llm import exact_dedup, packing, secrets, similar, toxicity
from flowlab.llm.common import drop_tables, table, tables_made, text_or_empty, written
from flowlab.llm.queries import CAPACITY, THRESHOLD, WORDS, in_training


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at the threshold or above go. Null and empty texts get the score of a text without matches; repeated rows stay."""
    grammar = toxicity.learn(docs, table(spark, sf_dir, "labels"), in_training())
    return toxicity.keep_clean(docs, grammar, THRESHOLD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty) the row with the smallest doc_id stays; of rows that repeat that id too, one."""
    found = exact_dedup.exact_dedup(docs, exact_dedup.earlier_half(docs))
    return _one_of_each(docs, found.where("kept").select("doc_id", F.hex("digest").alias("text_key")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose five-word shingles are similar to 0.8 or more the document with the smallest doc_id stays (with a null id only where all
    ids are), one row: documents are told apart by id and text, so null and repeated ids name no other text."""
    found = similar.similar_dedup(docs, width=5, similarity=0.8)
    return _one_of_each(docs, found.where("kept").select("doc_id", F.hex("digest").alias("text_key")))


def _one_of_each(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows named by (doc_id, text_key), one for each, with the columns they came with. The texts move once: the join and the last step have the same keys."""
    keys = (F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id_key"), "text_key")
    text_key = F.hex(exact_dedup.text_digest(text_or_empty())).alias("text_key")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), keys[0], text_key)
    named = keep.select(*keys).distinct()
    return rows.join(named, ["id_key", "text_key"], "left_semi").dropDuplicates(["id_key", "text_key"]).select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its place in a sequence. A null text is a piece with the end id alone."""
    pieces = packing.token_pieces(docs, public_tokenizers.path(WORDS), CAPACITY)
    packed = packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), CAPACITY)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("secret_scan", redact_secrets), ("packing", pack)]
#: Learning, fingerprints and packing are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what a stage wrote on its way goes once its result stands."""
    docs, begin = table(spark, sf_dir, "documents"), tables_made()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        drop_tables(spark, begin)
    return docs
