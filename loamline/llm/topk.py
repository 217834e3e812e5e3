"""Exact top-k by inner product over KD-trees, one tree a shard.

Each shard's rows are split at medians of the widest dimension; every node keeps
the tight bounding box of its points. For a query the largest inner product that
a box can hold is the sum over dimensions of the better of its two bounds. Nodes
are visited best first, and the traversal of a shard ends when no bound reaches
the query's k-th score, which is carried on to the next shard.

Defined cases: vectors that are null, empty or hold null or non-finite
components take no part, nor do rows without a vec_id; rows with the query's own
vec_id aren't its candidates; other repeated rows count each; ties go to the
smaller vec_id; vectors meet only those of their own dimension; an empty table
gives no row. Scores beyond the range of a long end at its bounds.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame

from loamline.llm.blocks import QUERY_ROWS, SHARD_ROWS, Arrays, offer, search, valid

LEAF_ROWS = 256


def build_tree(ids: np.ndarray, points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Arrays:
    """Rows in leaf order with boxes (low, high), children and row ranges of all nodes; node 0 is the root."""
    order = np.arange(len(ids))
    low, high, child, span = [], [], [], []
    stack = [(0, len(ids), -1, 0)]
    while stack:
        begin, end, parent, side = stack.pop()
        me = len(span)
        if parent >= 0:
            child[parent][side] = me
        rows = points[order[begin:end]]
        low.append(rows.min(0))
        high.append(rows.max(0))
        span.append((begin, end))
        child.append([-1, -1])
        if end - begin > leaf_rows:
            dim, middle = int(np.argmax(high[-1] - low[-1])), (end - begin) // 2
            order[begin:end] = order[begin:end][np.argpartition(rows[:, dim], middle)]
            stack += [(begin, begin + middle, me, 0), (begin + middle, end, me, 1)]
    return {"ids": ids[order], "points": points[order], "low": np.array(low), "high": np.array(high), "child": np.array(child), "span": np.array(span)}


def quantized(arrays: Arrays) -> Arrays:
    """Components floored after scaling by 256: whole numbers, held as doubles."""
    return {"ids": arrays["ids"], "vectors": np.floor(256.0 * arrays["vectors"])}


def exact_scores(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: doubles while every partial sum is exact, Python's integers beyond."""
    if len(query) * np.abs(points).max(initial=0) * np.abs(query).max(initial=0) < 2.0**53:
        return points @ query
    whole = [int(x) for x in query]
    top = 2**63 - 1
    return np.array([max(-top - 1, min(top, sum(int(a) * b for a, b in zip(p, whole)))) for p in points], object)


def visit(tree: Arrays, query: np.ndarray, own: int, k: int, best: list, bounds: np.ndarray) -> int:
    """Best-first traversal for one query; returns how many leaves it read."""
    heap, leaves = [(-bounds[0], 0)], 0
    while heap:
        bound, node = heapq.heappop(heap)
        if len(best) == k and -bound < best[-1][2]:
            break
        left, right = tree["child"][node]
        if left >= 0:
            heapq.heappush(heap, (-bounds[left], int(left)))
            heapq.heappush(heap, (-bounds[right], int(right)))
            continue
        leaves += 1
        begin, end = tree["span"][node]
        scores, ids = exact_scores(tree["points"][begin:end], query), tree["ids"][begin:end]
        chosen = np.flatnonzero((scores >= (best[-1][2] if len(best) == k else -np.inf)) & (ids != own))
        if len(chosen):
            whole = np.array([int(s) for s in scores[chosen]], object)
            offer(best, k, -whole, ids[chosen], whole)
    return leaves


def top_k(rows: DataFrame, is_query: Column, k: int = 5, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Each query row's k highest inner products: query_id, rank, vec_id, score."""

    def prepare(arrays: Arrays) -> Arrays:
        whole = quantized(arrays)
        return build_tree(whole["ids"], whole["vectors"])

    def over(tree: Arrays, queries: Arrays, best: list) -> None:
        q = queries["vectors"]
        # Rounding must never lower a bound below a true score.
        bounds = np.maximum(q, 0) @ tree["high"].T + np.minimum(q, 0) @ tree["low"].T
        bounds += np.abs(bounds) * 1e-9
        for i, own in enumerate(queries["ids"].tolist()):
            visit(tree, q[i], own, k, best[i], bounds[i])

    return search(valid(rows), is_query, prepare, quantized, over, k, "long", shard_rows, query_rows)
