"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, source mix, token files.

Each stage takes ``(spark, docs, sf_dir)`` and works on all the documents that its predecessor kept.
All but the last return the columns of ``documents``; the last returns, read back from the token
files, one row for each document in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import decontam, mixing, registry, simhash, tokens, toxicity
from loomgraph.session import remove, shared_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (cosine of the sets of five-word shingles 0.8 or more) the document with the least id stays."""
    return simhash.deduplicated(docs, shingle=5, radius=simhash.WIDE, similarity=0.8)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; what it leaves out goes."""
    return mixing.mixed_documents(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, written to token files and read back."""
    path = shared_path(spark, "pipeline-tokens")
    tokens.write_tokens(docs, path, registry.vocabulary())
    return tokens.read_tokens(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark),
    ("source_mix", mix_sources),
    ("token_output", write_token_files),
]

#: Stages train a classifier, hash under a seed and run a tokenizer, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage keeps is written as Parquet and read again, and goes when
    the next stage's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
