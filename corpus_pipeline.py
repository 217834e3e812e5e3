"""A corpus pipeline of five stages over ``documents``.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next stage's docs. All stages but the last return
the columns of ``documents``; a stage that changes a text sets n_chars anew.

Labels come from the table beside the documents. A classifier learns from the
labelled rows among the documents that its stage is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm import minhash, packing, quality, substring, toxicity
from loamline.session import fresh_path, materialize, table

#: Near duplicates share at least this percentage of their 5-word shingles.
NEAR_PERCENT = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality the classifier accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't find toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the first of those with the smallest doc_id.

    Rows count, not doc_ids: another text under a doc_id stays, repeated rows and
    copies without a doc_id go. Rows without words stay.
    """
    return minhash.representatives(docs, NEAR_PERCENT)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand earlier in the corpus."""
    return substring.cleaned(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 4096 tokens, with their ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("substring", substring_stage),
    ("packing", packing_stage),
]

#: The classifiers can't be expressed in SQL. The tests hold both dedup stages and the operators of the
#: other three against brute force; those stages themselves only against their operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
