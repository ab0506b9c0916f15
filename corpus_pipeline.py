"""A training-data pipeline over documents: quality, language, near duplicates, mix, packing.

Every stage but the last returns the columns of documents; each works on all that the one before kept.
Stages are written to the folder that executors share and read again, so a lost executor costs tasks, not
stages. Nulls, empty texts, repeated rows and empty tables have the results that the operators define.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanworks.llm import jaccard, langid, mixing, packing, quality
from gleanworks.llm.common import materialize, small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Below this share of the vote among languages, a text's language is too uncertain to keep it.
LEAST_SCORE = 0.4


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and boilerplate lines of the kept ones."""
    small_batches(spark)
    kept = quality.judged(docs.select(*COLUMNS), texts=True).where("kept")
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language that the model is sure of, go."""
    small_batches(spark)
    found = langid.identified(docs.select(*COLUMNS), keep=("text", "lang", "source", "n_chars"))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    groups = jaccard.linked(docs).select("doc_id", "component_id")
    # the others' ids, each once; a document without an id is nobody's copy
    copies = groups.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(copies, "doc_id", "left_anti")
    # repeated rows of one doc_id are one document
    twice = groups.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    again = docs.join(twice, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("x")).select("doc_id", "x.*").join(copies, "doc_id", "left_anti") if twice.limit(1).count() else None
    return kept.select(*COLUMNS) if again is None else kept.join(twice, "doc_id", "left_anti").select(*COLUMNS).unionByName(again.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    small_batches(spark)
    return mixing.taken(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 2048 tokens."""
    small_batches(spark)
    import public_tokenizers

    # fewer known words than packing alone would keep: workers still hold memory of the stages before
    return packing.packed(docs.select(*COLUMNS), public_tokenizers.path("word_bpe_49k.json"), known=40_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack),
]
#: SQL can't express the classifier, the rounding and the packing: tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each to all that the one before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
