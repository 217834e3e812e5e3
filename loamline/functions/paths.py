"""Paths as arrays of components, and how far two of them lie apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def components(path: Column) -> Column:
    """Components of a slash-separated path; the root is an empty array."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def parent(path: Column) -> Column:
    """The path of the directory that holds it; null for the root."""
    return F.when(F.size(path) > 0, F.slice(path, F.lit(1), F.size(path) - 1))


def common_roots(a: Column, b: Column) -> Column:
    """How many leading components are equal, file names included."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def distance(a: Column, b: Column, common: Column | None = None) -> Column:
    """Components of the longer path behind the common ones; null where nothing is common."""
    shared = common_roots(a, b) if common is None else common
    return F.when(shared > 0, F.greatest(F.size(a), F.size(b)) - shared)


def far_enough(a: Column, b: Column, min_distance: int, max_common_roots: int | None) -> Column:
    """Whether a pair may count as coupled; unrelated paths always may as far as distance goes."""
    shared = common_roots(a, b)
    keep = F.coalesce(distance(a, b, shared) >= min_distance, F.lit(True))
    return keep if max_common_roots is None else keep & (shared <= max_common_roots)
