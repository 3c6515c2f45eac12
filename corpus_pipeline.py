"""Corpus pipeline: language ID, near-duplicate removal, substring dedup, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each to Parquet in the shared folder
and reads it again as the next one's documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaypack.llm import bpe, langid, mixing, neardup, substring
from relaypack.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _of(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose id is among ``ids`` (id, ...); null is an id as any other here. Rows that share an id go together."""
    return docs.select(*COLUMNS).join(ids, F.col("doc_id").eqNullSafe(F.col("id")), how)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents rejected as no known language (or as empty) go; the others stay as they are."""
    return _of(docs, langid.documents(spark, docs).where("accepted").select(F.col("doc_id").alias("id")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five-word shingles, similarity 0.8 or more) the smallest id stays."""
    return _of(docs, neardup.near_duplicates(spark, docs, shingle=5, percent=80).where("kept").select(F.col("doc_id").alias("id")))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a smaller document has go; documents that lose all their words go."""
    out = substring.dedup(spark, docs.select(*COLUMNS), text_out=True)
    left = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
    return left.where((F.col("n_removed") == 0) | (F.col("text") != "")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for each copy the mix takes; documents with none go."""
    mixed = mixing.mix(spark, docs)
    copies = mixed.where("taken > 0").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("taken").cast("double") / F.col("size")).cast("int").alias("copies"))
    return _of(docs, copies, "inner").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document of the mix."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: Signatures, random order and BPE can't be told in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(spark, stage(spark, docs, sf_dir), name)
    return docs
