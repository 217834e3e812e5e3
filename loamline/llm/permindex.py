"""Approximate nearest neighbours by a permutation index.

A bounded sample of distinct vectors serves as pivots. Every vector is represented by
its nearest pivots in order, and posted in the inverted file of each with its place
in that order. A query reads the inverted files of its own nearest pivots, ranks
vectors by Spearman's footrule (a pivot that one side lacks counts as if it stood
just behind the last place), and the best, with all that tie with the last of them,
are reranked by true distance.

Each shard holds its own inverted files; the pivots, at most ``PIVOTS`` vectors,
are the same for all. Equal vectors of a shard are one entry with the smallest ids
that a query can need, so copies take no places from others and none of them is lost.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows without a vec_id; rows with the query's own
vec_id aren't its candidates; other repeated rows count each; ties go to the
smaller vec_id; vectors meet only those of their own dimension, and a dimension
without pivots is searched in full; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.llm.blocks import QUERY_ROWS, SHARD_ROWS, Arrays, offer, search, valid
from loamline.session import ship

#: Distinct vectors sampled as pivots (by their hash).
PIVOTS = 256
#: Places of a permutation that are kept.
LENGTH = 64
#: Share of a shard's distinct vectors that is reranked, and the least number of them.
RERANK_SHARE, RERANK_LEAST = 0.2, 256


def choose_pivots(rows: DataFrame, n: int = PIVOTS) -> dict[int, np.ndarray]:
    """The ``n`` distinct vectors that hash lowest, by dimension: at most n vectors reach the driver."""

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, None] = {}
        bound = (1 << 63) - 1
        for batch in batches:
            hashes = np.asarray(batch.column(0))
            for i in np.flatnonzero(hashes <= bound).tolist():
                held[int(hashes[i]), tuple(batch.column(1)[i].as_py())] = None
                if len(held) > 4 * n:
                    held = dict.fromkeys(sorted(held)[:n])
                    bound = max(held)[0]
        kept = sorted(held)[:n]
        arrays = [pa.array([h for h, _ in kept], pa.int64()), pa.array([list(v) for _, v in kept], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["hash", "embedding"])

    ship(rows.sparkSession)
    # Zeros of either sign are equal.
    plain = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)).alias("embedding")
    hashed = rows.select(plain).select(F.xxhash64("embedding").alias("hash"), "embedding")
    reduced = hashed.mapInArrow(lowest, "hash long, embedding array<double>").distinct()
    found = reduced.orderBy("hash", "embedding").limit(n).select("embedding").collect()
    by: dict[int, list] = {}
    for row in found:
        by.setdefault(len(row.embedding), []).append(row.embedding)
    return {dim: np.array(vectors) for dim, vectors in by.items()}


def distinct(arrays: Arrays, k: int) -> Arrays:
    """Distinct vectors, and behind one another the ids of each: its smallest, as many as leave k when a query's own id is taken out."""
    vectors = np.ascontiguousarray(arrays["vectors"] + 0.0)
    _, first, group = np.unique(vectors.view(f"V{vectors.itemsize * vectors.shape[1]}").ravel(), return_index=True, return_inverse=True)
    order = np.lexsort((arrays["ids"], group))
    ids, group = arrays["ids"][order], group[order]
    # Of one id k repeated rows can count, and k rows of other ids.
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (group[1:] != group[:-1])])
    few = np.arange(len(ids)) - np.flatnonzero(new)[np.cumsum(new) - 1] < k
    ids, group = ids[few], group[few]
    begins = np.searchsorted(group, np.arange(len(first)))
    few = np.arange(len(ids)) - begins[group] < 2 * k
    ids, group = ids[few], group[few]
    return {"vectors": vectors[first], "ids": ids, "owner": group, "first_id": np.searchsorted(group, np.arange(len(first) + 1))}


def permutation(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Numbers of each vector's nearest pivots, nearest first."""
    far = (pivots**2).sum(1) - 2 * vectors @ pivots.T
    return np.argsort(far, axis=1, kind="stable")[:, :length].astype(np.int16)


def invert(places: np.ndarray, n_pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inverted files, one behind another: where each pivot's begins, the rows in it, and the pivot's place for each."""
    length = places.shape[1]
    flat = places.ravel()
    order = np.argsort(flat, kind="stable")
    begins = np.searchsorted(flat[order], np.arange(n_pivots + 1))
    return begins, (order // length).astype(np.int32), (order % length).astype(np.int16)


def footrule_gain(begins: np.ndarray, posted: np.ndarray, place: np.ndarray, query: np.ndarray, n_rows: int) -> np.ndarray:
    """How far below its maximum each row's footrule distance to the query's permutation lies."""
    length = len(query)
    rows, gains = [], []
    for at, pivot in enumerate(query.tolist()):
        there = slice(begins[pivot], begins[pivot + 1])
        rows.append(posted[there])
        where = place[there].astype(np.int32)
        gains.append((length - at) + (length - where) - np.abs(at - where))
    return np.bincount(np.concatenate(rows), np.concatenate(gains), n_rows)


def nearest(
    rows: DataFrame,
    is_query: Column,
    k: int = 10,
    n_pivots: int = PIVOTS,
    length: int = LENGTH,
    share: float = RERANK_SHARE,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """Each query row's k nearest found by Euclidean distance: query_id, rank, vec_id, score."""
    rows = valid(rows, zero=False)
    pivots = choose_pivots(rows, n_pivots)

    def prepare(arrays: Arrays) -> Arrays:
        arrays = distinct(arrays, k)
        dim = arrays["vectors"].shape[1]
        if dim not in pivots:
            return arrays
        places = permutation(arrays["vectors"], pivots[dim], length)
        begins, posted, place = invert(places, len(pivots[dim]))
        return arrays | {"begins": begins, "posted": posted, "place": place}

    def prepare_query(arrays: Arrays) -> Arrays:
        dim = arrays["vectors"].shape[1]
        return arrays | ({"places": permutation(arrays["vectors"], pivots[dim], length)} if dim in pivots else {})

    def over(shard: Arrays, queries: Arrays, best: list) -> None:
        n = len(shard["vectors"])
        first = shard["first_id"]
        for i, own in enumerate(queries["ids"].tolist()):
            # Vectors that may have no other row than the query's own.
            without = len(np.unique(shard["owner"][shard["ids"] == own]))
            take = max(RERANK_LEAST, k + without, int(np.ceil(share * n)))
            chosen = np.arange(n)
            if "begins" in shard and take < n:
                gain = footrule_gain(shard["begins"], shard["posted"], shard["place"], queries["places"][i], n)
                chosen = np.flatnonzero(gain >= np.partition(gain, n - take)[n - take])
            distance = np.sqrt(((shard["vectors"][chosen] - queries["vectors"][i]) ** 2).sum(1))
            if len(chosen) > (enough := k + without):
                near = distance <= np.partition(distance, enough - 1)[enough - 1]
                chosen, distance = chosen[near], distance[near]
            ids = np.concatenate([shard["ids"][first[c] : first[c + 1]] for c in chosen.tolist()])
            distance = np.repeat(distance, first[chosen + 1] - first[chosen])
            other = ids != own
            ids, distance = ids[other], distance[other]
            order = np.lexsort((ids, distance))[:k]
            offer(best[i], k, distance[order], ids[order], distance[order])

    return search(rows, is_query, prepare, prepare_query, over, k, "double", shard_rows, query_rows)
