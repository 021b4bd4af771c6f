"""The corpus pipeline: five stages over ``documents``, each an operator of ``loomtext.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm import decontaminate, mixing, neardup, quality, tokens
from loomtext.llm.common import crc_mod, saved


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores at 0.5 or more; it learns as op10 does. Null texts score as empty ones; all columns stay as they are."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_mod("doc_id", 3) != 1)
    return quality.score(docs, quality.fit(docs, labels), out="__quality").where("__quality >= 0.5").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group linked at a SimHash similarity of 0.8 over five-word shingles; for null ids and texts see ``one_of_each``."""
    return neardup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than 5% lie in benchmark windows; null texts have no words and stay."""
    return decontaminate.decontaminated(docs, decontaminate.with_ids(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 2 times; rows that share an id are rows of their own."""
    return mixing.mixed_rows(docs)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read back from the written shards; a row for each row, repeated ones too."""
    return tokens.read_tokens(tokens.write_tokens(docs, tokens.default_tokenizer())).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("tokens", write_ids),
]

#: The classifier and the tokenizer have no SQL; test_pipeline_by_hand in tests/llm compares all rows and columns with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
