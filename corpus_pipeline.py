"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

toxicity (documents that the grammar rejects go), SimHash near-duplicates (one document of each
group stays), benchmark decontamination (documents that hold an item go), mixing (rows repeat
as often as the mix takes them) and token output (the ids' files, read back).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import decontaminate, mixing, simhash, tokens, toxicity
from quillstone.llm.common import scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the toxicity model, fitted on the labelled ones, does not predict as toxic.

    Each row is judged by its own text, null and empty ones as texts without a clause.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs.select(*COLUMNS), model, keep_text=True).where("predicted = 0").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest doc_id, nulls last, then the smallest hash of the text."""
    return simhash.keep_one(docs).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose own text holds no benchmark item; rows that share or lack a doc_id are told apart by their texts."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.decontaminate(docs, benchmark).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, which may be never."""
    return mixing.take(mixing.mix_sources(docs)).select(*COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids' files written and read back: one row for each row, (doc_id, start, n_tokens, ids_crc32)."""
    return tokens.token_output(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash", drop_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix),
    ("tokens", write_tokens),
]

#: SQL can express neither the grammar nor the fingerprints; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
