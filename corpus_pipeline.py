"""The training-data pipeline: five stages over ``documents``, each calling one operator of ``colweave.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's
docs. All but the last return the columns of documents. Toxic documents go; one document of each near-duplicate component
stays; benchmark passages are cut out, and a document mostly made of them goes; rows are repeated or left out to meet the source
weights; the rest is written as token ids. Rows repeated by the mix follow each other in the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colweave.llm import decontaminate, mixing, simhash, tokens, toxicity
from colweave.llm.common import table, written
from colweave.llm.queries import END_ID, THRESHOLD, _toxicity_model, tokenizer_file
from colweave.scratch import fresh_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.score(docs, _toxicity_model(spark, sf_dir, docs))
    return scored.where(F.col("score") < THRESHOLD).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "pipeline-tokens")
    tokens.write_tokens(docs, path, tokenizer_file(), END_ID)
    return tokens.token_digests(spark, path)


STAGES = [
    ("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_duplicates), ("decontamination", remove_benchmark),
    ("mixing", mix_sources), ("token_ids", write_token_ids),
]

#: The tokenizer, the trained tagger and the hashes have no counterpart in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
