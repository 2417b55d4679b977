"""Corpus pipeline: quality rules, exact dedup, near-duplicate join, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm import exact_dedup, near_join, packing, personal_data, quality_rules
from glyphlake.llm.common import stored, tokenizer_path


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars``, if there, follows the new text; null stays with null texts."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that fail; null and empty texts go."""
    return _counted(quality_rules.keep_good(docs))


def copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the largest id, one of rows that repeat; null ids only if there is no other."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the smallest id; null ids stay."""
    return near_join.drop_near_copies(docs)


def personal(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced; null texts stay null."""
    return _counted(personal_data.redact(docs))


def packed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality_rules", rules), ("exact_dedup", copies), ("ngram_jaccard", near_copies), ("pii", personal), ("packing", packed)]


def run(spark, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written as Parquet and read again by the next.

    All but the last keep the columns of ``documents``, extra ones under any name too. Null texts leave with the first stage, null ids are
    kept, repeated rows become one, texts of any length are read whole, and an empty table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs


#: Tokens and near-duplicate groups are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None
