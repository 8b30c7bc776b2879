"""Documents through the training-text operators, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the
last return the columns they were given; the last returns one row per document it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewise.llm import leaks, mixing, nearjoin, quality, tokens
from ratewise.llm.names import columns
from ratewise.llm.vectors import folder, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules of policy ``prose-1``."""
    rows = quality.ledger(docs.select(F.struct(*columns(docs)).alias("_row"), "text"), ["_row"])
    return rows.filter(quality.passes("prose-1")).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id."""
    return nearjoin.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return leaks.remove(docs, leaks.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document as often as the mix takes it."""
    return mixing.apply_mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards and their index; what reading each document back through the index gives."""
    import public_tokenizers

    return tokens.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), 1)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("token shards", write_tokens),
]

#: No SQL: the last stage calls a tokenizer. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; the rows of each are written once, beside the checkpoints, and read by the next one."""
    docs, home = spark.read.parquet(f"{sf_dir}/documents.parquet"), folder(spark, "pipeline")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = written(docs, f"{home}/{n}")
    return docs
