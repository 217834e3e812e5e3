"""Temporal coupling of files: bursts of activity, time buckets, files that change together.

``changes`` has file (components of its path) and t (epoch seconds), each pair
once. Files are numbered before they are joined. Instead of meeting every change
of every other file, bursts meet each file's activity in time bins as wide as
the overlap: only the first and last change in a bin matter, because a burst's
window always reaches beyond the bin in which it begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.config import CouplingConfig
from loamline.functions.paths import far_enough


def extract_changes(loc: DataFrame, history: DataFrame) -> DataFrame:
    """file and t of changes that add or delete lines, for files with code. loc: file, code; history: file, t, added, deleted."""
    code = loc.filter("code > 0").select("file")
    changed = history.filter("added > 0 or deleted > 0")
    return changed.join(code, "file", "left_semi").select("file", "t").distinct()


def bursts(changes: DataFrame, gap: int, key: str = "file") -> DataFrame:
    """key, burst, start, end, events: runs of changes that follow each other within ``gap`` seconds."""
    order = Window.partitionBy(key).orderBy("t")
    opens = F.coalesce((F.col("t") - F.lag("t").over(order) > gap).cast("int"), F.lit(1))
    numbered = changes.select(key, "t", opens.alias("opens")).withColumn("burst", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "burst").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("events"))


def layout(changes: DataFrame, bucket_size: int) -> DataFrame:
    """One row: earliest, latest, buckets and first_start; the last bucket ends at the latest change."""
    ends = changes.agg(F.min("t").alias("earliest"), F.max("t").alias("latest")).filter("latest is not null")
    count = F.floor((F.col("latest") - F.col("earliest")) / F.lit(bucket_size)).cast("long") + 1
    return ends.withColumn("buckets", count).withColumn("first_start", F.col("latest") - F.lit(bucket_size) * F.col("buckets") + 1)


def bucket_start(time: Column, bucket_size: int) -> Column:
    """The start of the bucket that a time lies in; null outside all of them."""
    number = F.floor((time - F.col("first_start")) / F.lit(bucket_size)).cast("long")
    return F.when((number >= 0) & (number < F.col("buckets")), F.col("first_start") + number * bucket_size)


def bucketed_bursts(changes: DataFrame, gap: int, bucket_size: int, key: str = "file") -> DataFrame:
    """Bursts with the bucket that their start lies in. The layout is one row."""
    one = F.broadcast(layout(changes, bucket_size))
    return bursts(changes, gap, key).crossJoin(one).withColumn("bucket_start", bucket_start(F.col("start"), bucket_size)).drop("earliest", "latest", "buckets", "first_start").filter("bucket_start is not null")


def partners(changes: DataFrame, found: DataFrame, overlap: int, key: str = "file") -> DataFrame:
    """key, bucket_start, other, together: in how many bursts another file changed at or after start - overlap and before end + overlap."""
    width = max(overlap, 1)
    bins = lambda t: F.floor(t / F.lit(width)).cast("long")
    active = changes.groupBy(F.col(key).alias("other"), bins(F.col("t")).alias("bin")).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    window = found.select(key, "burst", "bucket_start", (F.col("start") - overlap).alias("low"), (F.col("end") + overlap).alias("high")).filter("low < high")
    met = window.withColumn("bin", F.explode(F.sequence(bins(F.col("low")), bins(F.col("high") - 1)))).join(active, "bin")
    inside = (F.col("last") >= F.col("low")) & (F.col("first") < F.col("high"))
    once = met.filter(inside & (F.col(key) != F.col("other"))).select(key, "bucket_start", "burst", "other").distinct()
    return once.groupBy(key, "bucket_start", "other").agg(F.count("*").alias("together"))


def couple(changes: DataFrame, config: CouplingConfig) -> tuple[DataFrame, DataFrame]:
    """Activity (file, bucket_start, bucket_end, activity_bursts) and coupled (file, bucket_start, other, together)."""
    names = changes.select("file").distinct().withColumn("file_id", F.xxhash64("file"))
    numbered = changes.select(F.xxhash64("file").alias("file_id"), "t")
    found = bucketed_bursts(numbered, config.gap, config.bucket_size, "file_id")
    active = found.groupBy("file_id", "bucket_start").agg(F.count("*").alias("activity_bursts")).filter(F.col("activity_bursts") >= config.min_bursts)
    # Bursts of files that are too quiet for a bucket need no partners.
    lively = found.join(active.select("file_id", "bucket_start"), ["file_id", "bucket_start"], "left_semi")
    pairs = partners(numbered, lively, config.overlap, "file_id").join(active, ["file_id", "bucket_start"])
    pairs = pairs.filter(F.col("together").cast("double") / F.col("activity_bursts") >= config.min_ratio)
    # Each pair of files is judged once, after counting, not in every burst.
    near = pairs.join(names, "file_id").join(names.select(F.col("file_id").alias("other"), F.col("file").alias("other_file")), "other")
    kept = near.filter(far_enough(F.col("file"), F.col("other_file"), config.min_distance, config.max_common_roots))
    activity = active.join(names, "file_id").select("file", "bucket_start", (F.col("bucket_start") + config.bucket_size - 1).alias("bucket_end"), "activity_bursts")
    return activity, kept.select("file", "bucket_start", F.col("other_file").alias("other"), "together")


def coupling(changes: DataFrame, config: CouplingConfig) -> DataFrame:
    """file, bucket_start, bucket_end, activity_bursts, coupled_files; files without partners keep an empty list."""
    activity, coupled = couple(changes, config)
    lists = coupled.groupBy("file", "bucket_start").agg(F.array_sort(F.collect_list(F.struct(F.col("other").alias("file"), F.col("together").alias("count")))).alias("coupled_files"))
    empty = F.array().cast("array<struct<file:array<string>,count:bigint>>")
    return activity.join(lists, ["file", "bucket_start"], "left").withColumn("coupled_files", F.coalesce("coupled_files", empty))


def nested(coupled: DataFrame) -> DataFrame:
    """file and buckets: one ascending array per file."""
    return coupled.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("bucket_start", "bucket_end", "activity_bursts", "coupled_files"))).alias("buckets"))
