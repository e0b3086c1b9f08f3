"""Curation of the ``documents`` table: five stages, each calling one operator of ``loam.llm``.

Each stage takes what the one before it kept, as written and read again. All but
the last return the columns of ``documents``; the last returns each kept
document's token count and digests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import bpe_duckdb, latent_leaks, line_alignment, quality_divergence, simhash_tiles
from loam.llm._shared import among, by_text
from loam.storage import forget, stored, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the language references keep; rows of one id are judged by their own texts."""
    rejected = quality_divergence.judge(by_text(docs, "doc_id", "text"), "__row").where("not kept")
    return among(docs, rejected, "doc_id", "text", "left_anti")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks of lines that an earlier document has; documents left without a word go."""
    out = line_alignment.align(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id."""
    return simhash_tiles.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that restate no item of ``benchmark``."""
    return latent_leaks.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of tokens, and digests of its ids and of what they decode to."""
    return bpe_duckdb.digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontamination),
    ("bpe_tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. Tables of the shared folder go as soon as the next stage is written; that which the last one reads stays."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(written(spark))
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        forget(spark, since, but_last=1)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Patience alignment, SimHash components and the singular value decomposition aren't SQL.
ORACLE_SQL = None
