"""A whole scan: tree, indicators, coupling, document."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.config import ScanConfig
from loamline.operators import coupling
from loamline.plans.registry import Context, calculators
from loamline.session import materialize, ship
from loamline.sinks.document import document, plain
from loamline.sources.gitlog import GitLog
from loamline.sources.tree import SourceTree


def register_sources(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(SourceTree)
    spark.dataSource.register(GitLog)


def scan(spark: SparkSession, config: ScanConfig, now: int | None = None) -> tuple[DataFrame, list[str], Context, dict]:
    """Nodes with a column per indicator, the indicators' names, the context and the metadata."""
    register_sources(spark)
    root = os.path.realpath(config.root)
    config = ScanConfig(**{**config.__dict__, "root": root})
    nodes = spark.read.format("source_tree").option("follow_symlinks", str(config.follow_symlinks).lower()).load(root)
    context = Context(spark, config, materialize(nodes, "nodes"), int(time.time()) if now is None else now)
    chosen = calculators(config)
    out = context.nodes.select("path", "name", "is_file", "walk_ord")
    names, metadata = [], {}
    for calculator in chosen:
        out = out.join(calculator.compute(context), "path", "left")
        names.append(calculator.name)
        metadata |= calculator.metadata(context)
    if config.coupling:
        loc = context.frames["loc"].select(F.col("path").alias("file"), F.col("loc.code").alias("code"))
        history = context.frames["history"].select(F.col("path").alias("file"), F.col("commit_time").alias("t"), F.col("lines_added").alias("added"), F.col("lines_deleted").alias("deleted"))
        changes = materialize(coupling.extract_changes(loc, history), "changes")
        if not changes.isEmpty():
            found = coupling.nested(coupling.coupling(changes, config.coupling))
            out = out.join(found.select(F.col("file").alias("path"), F.struct("buckets").alias("coupling")), "path", "left")
            names.append("coupling")
            one = coupling.layout(changes, config.coupling.bucket_size).first()
            metadata["coupling"] = {"config": config.coupling.metadata(), "buckets": {"bucket_count": one.buckets, "bucket_size": config.coupling.bucket_size, "first_bucket_start": one.first_start}}
    return out, names, context, metadata


def scan_document(spark: SparkSession, config: ScanConfig, now: int | None = None) -> dict:
    """The nested document of a scan."""
    return documented(config, scan(spark, config, now))


def documented(config: ScanConfig, scanned: tuple[DataFrame, list[str], Context, dict]) -> dict:
    """The nested document of what :func:`scan` has found."""
    nodes, names, context, metadata = scanned
    features = {"git": config.git, "coupling": config.coupling is not None, "git_details": config.git_details, "file_stats": config.file_stats}
    found = document(nodes, names, config.name or os.path.basename(context.config.root), config.id, plain(metadata), features)
    _merge_git(found["tree"])
    return found


def _merge_git(node: dict) -> None:
    """A node's git entry is its file's or its directory's, without a level between."""
    if git := node.get("data", {}).get("git"):
        node["data"]["git"] = git["file_git"] or git["directory_git"]
    for child in node.get("children", ()):
        _merge_git(child)
