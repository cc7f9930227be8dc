"""The corpus pipeline: a list of stages, each over all that the one before kept.

Stages get the documents of their predecessor (read again from Parquet) and give
documents with the same columns; the last one gives token counts and ids. All of them
take null and repeated ids, null and empty texts and further columns: columns that a
stage does not know go through it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import byte_bpe, decontaminate, simhash, suffix_dedup, toxicity
from tidegauge.llm.rows import numbered, restored, staged

TOXIC = 0.7
RANKS = "byte_bpe_multi_50k.tiktoken"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC; a null or empty text has no evidence and stays."""
    model = toxicity.learn(docs, "doc_id", "text", spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, name = numbered(docs)
    return restored(toxicity.score(rows, name("text"), model).where(F.col("score") < TOXIC), docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one of the smallest id."""
    return simhash.keep_one(docs, "doc_id", "text")


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes that occur more than once.

    Every document stays, if only as an empty text; n_chars follows the new text.
    """
    out = suffix_dedup.cut_documents(docs, "text")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which fewer than 5 % of the words stand in benchmark items."""
    rows, name = numbered(docs)
    found = decontaminate.find(rows, name("text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text")
    return restored(decontaminate.verdict(found).where(~F.col("contaminated")), docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    import public_tokenizers

    ranks = public_tokenizers.path(RANKS)
    both = byte_bpe.encode_and_decode(docs.select("doc_id", "text"), "text", ranks, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", simhash_stage),
    ("suffix_array_dedup", suffix_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("byte_level_bpe", bpe_stage),
]

#: The fitted field, components and merges are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each but the last written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
