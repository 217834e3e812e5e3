"""Vectors in blocks: shards of all rows met by blocks of queries.

Rows are dealt round-robin into shards of a fixed size, so no key decides where
a row goes and nothing can become hot. The shards of a group stream past a
bounded number of query blocks; the worker holds one shard at a time and carries
each query's best results from shard to shard.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.session import materialize, ship

SHARD_ROWS = 8192
QUERY_ROWS = 512
#: Query blocks that a worker holds at once, and shards that stream past them in one task.
CELL_BLOCKS, CELL_SHARDS = 32, 256
#: More blocks than a partition ever makes.
PART_BLOCKS = 1_000_000

Arrays = dict[str, np.ndarray]


def dump(arrays: Arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def load(data: bytes) -> Arrays:
    with np.load(io.BytesIO(data), allow_pickle=False) as found:
        return {k: found[k] for k in found.files}


def valid(df: DataFrame, zero: bool = True) -> DataFrame:
    """Rows with an id and a non-empty vector of finite components; ``zero=False`` also drops zero vectors."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    keep = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(finite, F.lit(False))
    if not zero:
        keep &= F.exists("embedding", lambda x: x != 0)
    return df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).filter(keep)


def into_blocks(rows: DataFrame, size: int, prepare: Callable[[Arrays], Arrays], label: str) -> DataFrame:
    """(block, dim, data): at most ``size`` rows of one dimension each, prepared and serialised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def emit(dim: int) -> Iterator[pa.RecordBatch]:
            nonlocal made
            parts = waiting.pop(dim)
            ids, vectors = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            for begin in range(0, len(ids), size):
                data = dump(prepare({"ids": ids[begin : begin + size], "vectors": vectors[begin : begin + size]}))
                yield pa.RecordBatch.from_arrays([pa.array([part * PART_BLOCKS + made], pa.int64()), pa.array([dim], pa.int32()), pa.array([data], pa.binary())], ["block", "dim", "data"])
                made += 1

        for batch in batches:
            column = batch.column(1)
            lengths, flat = np.asarray(column.value_lengths()), np.asarray(column.flatten())
            starts, ids = np.cumsum(lengths) - lengths, np.asarray(batch.column(0))
            for dim in np.unique(lengths):
                chosen = np.flatnonzero(lengths == dim)
                waiting.setdefault(int(dim), []).append((ids[chosen], flat[starts[chosen][:, None] + np.arange(dim)]))
                if sum(len(p[0]) for p in waiting[int(dim)]) >= size:
                    yield from emit(int(dim))
        for dim in list(waiting):
            yield from emit(dim)

    ship(rows.sparkSession)
    n = rows.count()
    dealt = rows.repartition(max(1, -(-n // size)))
    return materialize(dealt.mapInArrow(run, "block long, dim int, data binary"), label)


def search(
    rows: DataFrame,
    is_query: Column,
    prepare_shard: Callable[[Arrays], Arrays],
    prepare_query: Callable[[Arrays], Arrays],
    visit: Callable[[Arrays, Arrays, list], None],
    k: int,
    score_type: str,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """Each query's ``k`` best: query_id, rank, vec_id, score.

    ``visit(shard, queries, best)`` improves ``best``, one ascending list of
    (sort key, vec_id, score) a query. Lists of the shard groups are merged by a
    window of at most k rows a group.
    """
    spark = rows.sparkSession
    shards = into_blocks(rows, shard_rows, prepare_shard, "shards")
    blocks = into_blocks(rows.filter(is_query), query_rows, prepare_query, "queries")
    n_blocks, n_shards = max(1, blocks.count()), max(1, shards.count())
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The stated query set against all rows, in blocks: a cell is a group of blocks, which a worker
    # holds, and a group of shards, which stream past them. Blocks and shards are copied to their
    # cells and meet there, so no pair of them is ever a row.
    block_groups = -(-n_blocks // CELL_BLOCKS)
    shard_groups = min(n_shards, max(-(-wanted // block_groups), -(-n_shards // CELL_SHARDS)))
    number = F.floor(F.col("block") / PART_BLOCKS) + F.col("block") % PART_BLOCKS

    def copies(kind: int, own: int, other: int) -> list[Column]:
        mine, theirs = F.pmod(number, F.lit(own)).cast("long"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long")))
        return [mine.alias("mine"), theirs.alias("theirs"), F.lit(kind).alias("kind"), F.col("block"), F.col("dim"), F.col("data")]

    left = blocks.select(*copies(0, block_groups, shard_groups)).withColumn("cell", F.col("mine") * shard_groups + F.col("theirs"))
    right = shards.select(*copies(1, shard_groups, block_groups)).withColumn("cell", F.col("theirs") * shard_groups + F.col("mine"))
    columns = ["cell", "kind", "block", "dim", "data"]
    met = left.select(columns).unionByName(right.select(columns)).repartition("cell").sortWithinPartitions("cell", "kind", "block")
    kind = pa.float64() if score_type == "double" else pa.int64()
    names = ["query_block", "query_row", "query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: int | None = None
        held: list[tuple[int, int, Arrays, list]] = []

        def emit() -> Iterator[pa.RecordBatch]:
            for block, _, queries, best in held:
                flat = [(block, i, int(queries["ids"][i]), vec, score) for i, found in enumerate(best) for _, vec, score in found]
                columns = list(zip(*flat)) or [[]] * 5
                kinds = [pa.int64()] * 4 + [kind]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        for batch in batches:
            for i in range(batch.num_rows):
                cell, is_shard, block, dim = (batch.column(c)[i].as_py() for c in range(4))
                if cell != at:
                    yield from emit()
                    at, held = cell, []
                arrays = load(batch.column(4)[i].as_py())
                if not is_shard:
                    held.append((block, dim, arrays, [[] for _ in arrays["ids"]]))
                    continue
                for _, wanted_dim, queries, best in held:
                    if wanted_dim == dim:
                        visit(arrays, queries, best)
        yield from emit()

    found = met.mapInArrow(run, f"query_block long, query_row long, query_id long, vec_id long, score {score_type}")
    # At most k rows a query and shard group reach this window.
    best_first = F.col("score").desc() if score_type == "long" else F.col("score")
    rank = F.row_number().over(Window.partitionBy("query_block", "query_row").orderBy(best_first, "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def offer(best: list, k: int, keys: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
    """Merge candidates into one query's ascending list of at most k."""
    best.extend(zip(keys.tolist(), ids.tolist(), scores.tolist()))
    best.sort()
    del best[k:]
