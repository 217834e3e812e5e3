"""Dense numbers for people, in the order in which they are first seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions.people import folded


def dictionary(seen: DataFrame) -> DataFrame:
    """user_id and user (as first written) of every person, told apart without case.

    ``seen``: user, and order columns behind it. People are aggregated before
    they are numbered, so the one global order is over distinct people alone.
    """
    order = [c for c in seen.columns if c != "user"]
    first = seen.groupBy(folded(F.col("user")).alias("key")).agg(F.min(F.struct(*order, "user")).alias("first"))
    number = F.row_number().over(Window.orderBy("first", "key")) - 1
    return first.select("key", number.cast("long").alias("user_id"), F.col("first.user").alias("user"))


def numbered(changes: DataFrame, users: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and users: the sorted distinct numbers of each row's people (``people``: array of user)."""
    each = changes.select(*keys, F.explode("people").alias("user")).withColumn("key", folded(F.col("user"))).join(users.select(F.col("key").alias("k"), "user_id"), F.col("key").eqNullSafe(F.col("k")))
    return each.groupBy(*keys).agg(F.array_sort(F.collect_set("user_id")).alias("users"))
