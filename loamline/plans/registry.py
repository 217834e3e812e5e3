"""Calculators of indicators by name, open to further ones."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.config import ScanConfig
from loamline.operators import commits, history, indicators, renames, users
from loamline.sinks.document import user_list
from loamline.sources import gitlog
from loamline.functions.people import people_of_change
from loamline.session import materialize


@dataclass
class Context:
    """What calculators share: the scanned nodes, the settings and frames that others may use."""

    spark: SparkSession
    config: ScanConfig
    nodes: DataFrame
    now: int
    frames: dict[str, DataFrame] = field(default_factory=dict)


class Calculator(Protocol):
    """Computes one column of indicators keyed by path."""

    name: str

    def compute(self, context: Context) -> DataFrame:
        """path and one struct column called ``name``."""

    def metadata(self, context: Context) -> dict:
        """Entries of the document's metadata."""


class _Plain:
    def metadata(self, context: Context) -> dict:
        return {}


class Loc(_Plain):
    name = "loc"

    def compute(self, context: Context) -> DataFrame:
        found = indicators.loc(context.nodes.filter("is_file"), context.config.unknown_as_text)
        context.frames["loc"] = found
        return found


class Indentation(_Plain):
    name = "indentation"

    def compute(self, context: Context) -> DataFrame:
        return indicators.indentation(indicators.code_lines(context.nodes.filter("is_file")))


class FileStats(_Plain):
    name = "file_stats"

    def compute(self, context: Context) -> DataFrame:
        return context.nodes.select("path", F.struct("created", "modified").alias("file_stats"))


class Git:
    """Histories of all repositories that the tree's files lie in."""

    name = "git"

    def compute(self, context: Context) -> DataFrame:
        config, spark = context.config, context.spark
        absolute = F.concat(F.split(F.lit(config.root.strip("/")), "/"), "path")
        roots = [config.root] + ["/".join([config.root, *r.path]) for r in context.nodes.filter("git_dir").select("path").collect() if r.path]
        repos = list(dict.fromkeys(gitlog.discover(r) for r in roots))
        log = spark.read.format("git_log").load("\n".join(repos))
        log = materialize(commits.until_horizon(log, commits.earliest(context.now, config.years)), "log")
        summarised = commits.summarised(log)
        all_changes = commits.changes(summarised, config.include_merges)
        final = renames.final_names(all_changes.select("repo", "id", "file"), log, all_changes)
        named = all_changes.join(final, ["repo", "id", "file"])
        places = spark.createDataFrame([(r, [x for x in r.split("/") if x], i) for i, r in enumerate(repos)], "repo string, root array<string>, load_ord int")
        files = context.nodes.filter("is_file").select("path", "walk_ord", absolute.alias("absolute"))
        home = history.repository_of(files.select(F.col("absolute").alias("path")), places, config.nearest_repository)
        inside = files.join(home.withColumnRenamed("path", "absolute"), "absolute").join(F.broadcast(places.select("repo", F.size("root").alias("depth"))), "repo")
        relative = F.array_join(F.slice("absolute", F.col("depth") + 1, F.greatest(F.size("absolute") - F.col("depth"), F.lit(0))), "/")
        keyed = inside.select("path", "walk_ord", "repo", relative.alias("final"))
        rows = named.join(keyed, ["repo", "final"]).withColumn("people", people_of_change(F.col("author"), F.col("committer"), F.col("co_authors")))
        rows = materialize(rows.drop("message"), "changes")
        seen = rows.select("walk_ord", "ord", "change_ord", F.posexplode("people").alias("user_ord", "user"))
        context.frames["users"] = people = materialize(users.dictionary(seen), "users")
        numbers = users.numbered(rows, people, ["repo", "id", "change_ord"])
        changed = materialize(rows.join(numbers, ["repo", "id", "change_ord"]), "history")
        context.frames["history"] = changed
        summary = history.activity(changed.drop("file").withColumnRenamed("path", "file"), history.last_commits(log))
        days = history.nested_details(changed.drop("file").withColumnRenamed("path", "file")).withColumnRenamed("file", "path")
        empty = F.array().cast("array<struct<commit_day:bigint,users:array<bigint>,commits:bigint,lines_added:bigint,lines_deleted:bigint>>")
        shown = F.col("details") if config.git_details else empty
        of_files = summary.withColumnRenamed("file", "path").join(days, "path").select(
            "path",
            F.struct("last_update", "age_in_days", "creation_date", "user_count", "users", shown.alias("details"), F.array().cast("array<string>").alias("activity")).alias("file_git"),
        )
        described = [(list(r.path), *gitlog.info("/".join([config.root, *r.path]))) for r in context.nodes.filter("git_dir").select("path").collect()]
        of_directories = spark.createDataFrame(described, "path array<string>, remote_url string, head string").select("path", F.struct("remote_url", "head").alias("directory_git"))
        return of_files.join(of_directories, "path", "full").select("path", F.struct("file_git", "directory_git").alias("git"))

    def metadata(self, context: Context) -> dict:
        return {"git": {"users": user_list(context.frames["users"])}}


REGISTRY: dict[str, type] = {c.name: c for c in (Loc, Indentation, Git, FileStats)}


def register(calculator: type) -> type:
    """Add a calculator to those that a scan can name; also a class decorator."""
    REGISTRY[calculator.name] = calculator
    return calculator


def calculators(config: ScanConfig) -> list[Calculator]:
    unknown = [n for n in config.calculators if n not in REGISTRY]
    if unknown:
        raise ValueError(f"unknown calculators: {', '.join(unknown)}")
    return [REGISTRY[n]() for n in config.calculators]
