"""Per-file aggregates of change histories.

A history has one row per change: file, change, commit_time, author_time,
lines_added, lines_deleted and users (sorted numbers).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.config import DAY


def day(time: Column) -> Column:
    """The start of the UTC day."""
    return F.floor(time / F.lit(DAY)).cast("long") * DAY


def last_commits(log: DataFrame, repo: str = "repo") -> DataFrame:
    return log.groupBy(repo).agg(F.max("commit_time").alias("last_commit"))


def activity(history: DataFrame, last_commit: int | DataFrame, key: str = "file") -> DataFrame:
    """last_update, age_in_days, creation_date, users and user_count of every file.

    A file's creation is the first author time of an addition, unless some change
    has an earlier one. ``last_commit``: one number, or a frame (repo, last_commit)
    for histories with a repo.
    """
    grouped = [key] if isinstance(last_commit, int) else ["repo", key]
    added = F.when(F.col("change") == "Add", F.col("author_time"))
    # A file's changes move once, as they are; single users and their sets are made where they meet.
    rows = history.select(*grouped, "commit_time", "author_time", added.alias("added"), "users").repartition(*grouped)
    each = rows.select(*grouped, "commit_time", "author_time", "added", F.explode_outer("users").alias("u"))
    joined = each.groupBy(*grouped).agg(
        F.max("commit_time").alias("last_update"), F.min("added").alias("added"), F.min("author_time").alias("first"), F.array_sort(F.collect_set("u")).alias("users")
    )
    if isinstance(last_commit, int):
        joined = joined.withColumn("last_commit", F.lit(last_commit).cast("long"))
    else:
        joined = joined.join(last_commit, "repo")
    age = F.floor((F.col("last_commit") - F.col("last_update")) / F.lit(DAY)).cast("long")
    created = F.when(F.col("added") <= F.col("first"), F.col("added"))
    return joined.select(*grouped, "last_update", age.alias("age_in_days"), created.alias("creation_date"), "users", F.size("users").cast("long").alias("user_count"))


def details(history: DataFrame, key: str = "file") -> DataFrame:
    """Changes and changed lines by file, author day and set of users; a merge counts once per parent it differs from."""
    return history.groupBy(key, day(F.col("author_time")).alias("day"), "users").agg(
        F.count("*").alias("commits"), F.sum("lines_added").alias("lines_added"), F.sum("lines_deleted").alias("lines_deleted")
    )


def nested_details(history: DataFrame, key: str = "file") -> DataFrame:
    """:func:`details` as one sorted array per file, in the document's names."""
    return details(history, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("day").alias("commit_day"), "users", "commits", "lines_added", "lines_deleted"))).alias("details"))


def repository_of(files: DataFrame, repositories: DataFrame, nearest: bool = False) -> DataFrame:
    """The repository that a file's path lies in: the one loaded first, or the nearest.

    ``files``: path; ``repositories``: repo, root (components), load_ord. Files
    meet repositories on equal prefixes, not on a comparison of all with all.
    """
    keyed = files.select("path", F.explode(F.sequence(F.lit(0), F.size("path"))).alias("depth")).withColumn("root", F.slice("path", F.lit(1), F.col("depth")))
    met = keyed.join(repositories, "root")
    order = F.struct((-F.col("depth")).alias("d"), "load_ord") if nearest else F.struct("load_ord", F.col("depth").alias("d"))
    return met.groupBy("path").agg(F.min_by("repo", order).alias("repo"))
