"""The corpus pipeline: documents to token files in stages, each one operator of ``formlake.llm``.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame that is written as Parquet and reread. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlake.llm import common, decontaminate, minhash_forest, mixture, token_files, toxicity
from formlake.llm.queries import tokenizer_path

REPETITION = 2.0  # no source is used more than twice
NEAR_PERCENT = 80  # likeness of word shingles from which documents are near duplicates


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is not among ``ids``; rows without an id stay."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from the labelled ones among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_toxicity(docs, labels)
    return _without(docs, scored.where("predicted = 1 and doc_id is not null"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return _without(docs, minhash_forest.near_duplicates(docs, percent=NEAR_PERCENT).where("not kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontaminate.decontaminate(docs, benchmark).where("contaminated and doc_id is not null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture uses them; every document stays at least once."""
    copies = mixture.mix_sources(docs, repetition=REPETITION).where("doc_id is not null").groupBy("doc_id").agg(
        F.max("copies").alias("copies"))
    return (docs.join(copies, "doc_id", "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)).cast("int"))))
            .select(docs.columns))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of all that is left, in id order, and each document's digest read back from them."""
    return token_files.token_digest(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixture", mix),
    ("tokens", write_tokens),
]

# Model fitting, min-hashing and tokenizing are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
