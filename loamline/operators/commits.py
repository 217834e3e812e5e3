"""Commit logs: horizon, merges, changes.

A log has repo, ord (place in topological order from HEAD), id, message,
parents, committer, commit_time, author, author_time and file_changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.config import DAY
from loamline.functions.people import co_authors, first_paragraph

KINDS = {"A": "Add", "R": "Rename", "D": "Delete", "M": "Modify", "C": "Copied"}


def earliest(now: int, years: int) -> int:
    return now - years * 365 * DAY


def summarised(log: DataFrame) -> DataFrame:
    """Adds summary and co_authors from the message."""
    return log.withColumn("summary", first_paragraph(F.col("message"))).withColumn("co_authors", co_authors(F.col("message")))


def until_horizon(log: DataFrame, since: int, repo: str = "repo", order: str = "ord", time: str = "commit_time") -> DataFrame:
    """The log of each repository up to its first commit before ``since``: newer commits behind that one go too."""
    cut = log.filter(F.col(time) < since).groupBy(repo).agg(F.min(order).alias("cut at"))
    return log.join(cut, repo, "left").filter(F.col("cut at").isNull() | (F.col(order) < F.col("cut at"))).select(*(log[c] for c in log.columns))


def change_kind(status: Column) -> Column:
    """The kind of a change by the first letter of its status; null for letters that aren't kept."""
    kind = F.lit(None).cast("string")
    for letter, name in KINDS.items():
        kind = F.when(F.substring(status, 1, 1) == letter, name).otherwise(kind)
    return kind


def changes(log: DataFrame, include_merges: bool = True) -> DataFrame:
    """One row per file change with its commit's columns; merges differ from each parent, or count nothing."""
    kept = log if include_merges else log.filter(F.size("parents") <= 1)
    rest = [c for c in log.columns if c != "file_changes"]
    return kept.select(*rest, F.posexplode("file_changes").alias("change_ord", "c")).select(*rest, "change_ord", "c.*")
