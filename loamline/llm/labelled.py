"""Labelled training rows of documents, held-out rows set apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: crc32(doc_id as text) modulo this; remainder 0 is held out.
FOLDS = 5
#: Bytes of a training text at most; longer labelled texts are left out of the sample.
MOST_BYTES = 1 << 18


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label) of at most about ``per_class`` rows of either class, and how many rows each class has.

    Rows are chosen by the hash of their doc_id, so the sample doesn't depend on
    partitions; held-out rows are never among them. A doc_id labelled twice
    counts by its smallest label, one that stands several times by its smallest
    text, and texts over ``MOST_BYTES`` aren't taken, so the sample is bounded in
    rows and bytes.
    """
    marked = (
        labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
        .groupBy("doc_id").agg(F.min("label").alias("label"))
    )
    counts = {int(r.label): int(r["count"]) for r in marked.groupBy("label").count().collect()}
    # A threshold on the hash keeps the expected number, without an ordering of all labels.
    limit = F.lit(0.0)
    for value, n in counts.items():
        limit = F.when(F.col("label") == value, F.lit(min(1.0, per_class / n))).otherwise(limit)
    chosen = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < limit * 1_000_000)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # At most two classes' bounds of (long, int) rows: a few hundred kB.
    met = texts.filter(F.octet_length("text") <= MOST_BYTES).join(F.broadcast(chosen), "doc_id")
    return met.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")), counts
