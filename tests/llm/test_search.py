import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.llm import blocks, permindex, topk

SCHEMA = "vec_id long, embedding array<float>, rank string, score int"


def rows(n=700, dim=12, seed=1):
    rng = np.random.default_rng(seed)
    made = [(i, [float(x) for x in rng.standard_normal(dim).astype(np.float32)], "a", 1) for i in range(n)]
    made += [(n + i, made[i][1], "b", 2) for i in range(40)]  # ties
    made += [(5, made[9][1], "c", 3)]  # a repeated id
    made += [(9001, None, "d", 4), (9002, [], "d", 4), (9003, [1.0, None] * 6, "d", 4), (9004, [float("nan")] * dim, "d", 4), (9005, [float("inf")] * dim, "d", 4), (None, made[0][1], "d", 4)]
    made += [(9100, [0.0] * dim, "e", 5), (9200, [1.0, 2.0], "f", 6), (9201, [2.0, 1.0], "f", 6)]
    return made


def usable(made, zero):
    return [(i, np.array(v, np.float64)) for i, v, *_ in made if i is not None and v and None not in v and np.isfinite(v).all() and (zero or any(v))]


def brute(made, every, k, inner):
    found = {}
    base = usable(made, inner)
    vectors = [(i, np.floor(256 * v) if inner else v) for i, v in base]
    for q, v in vectors:
        if q % every == 0:
            scored = [(-int(x @ v) if inner else float(np.sqrt(((x - v) ** 2).sum())), i) for i, x in vectors if i != q and len(x) == len(v)]
            found.setdefault(q, []).append([(i, -s if inner else s) for s, i in sorted(scored)[:k]])
    return found


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


@pytest.mark.parametrize("cells", [(32, 256), (2, 1), (1, 2)])
def test_exact_top_k(spark, monkeypatch, cells):
    monkeypatch.setattr(blocks, "CELL_BLOCKS", cells[0])
    monkeypatch.setattr(blocks, "CELL_SHARDS", cells[1])
    made = rows()
    got = collected(topk.top_k(spark.createDataFrame(made, SCHEMA), F.col("vec_id") % 50 == 0, 5, shard_rows=150, query_rows=4))
    for q, (want,) in brute(made, 50, 5, True).items():
        assert got[q] == [(n + 1, i, s) for n, (i, s) in enumerate(want)], q
    assert set(got) == {q for q in brute(made, 50, 5, True)}


def test_few_candidates_and_large_numbers(spark):
    made = [(0, [1.0, 1e30], "", 0), (1, [1e30, 1e30], "", 0), (2, [0.5, -1e30], "", 0)]
    got = collected(topk.top_k(spark.createDataFrame(made, SCHEMA), F.col("vec_id") == 0, 5))
    assert [(r, i) for r, i, _ in got[0]] == [(1, 1), (2, 2)]
    assert got[0][0][2] == 2**63 - 1 and got[0][1][2] == -(2**63)


def test_traversal_prunes():
    rng = np.random.default_rng(3)
    points = np.floor(256 * rng.standard_normal((4000, 3)))
    tree = topk.build_tree(np.arange(4000), points, 50)
    q = points[7]
    bounds = np.maximum(q, 0) @ tree["high"].T + np.minimum(q, 0) @ tree["low"].T
    best = []
    assert topk.visit(tree, q, -1, 5, best, bounds) < 40
    assert [b[2] for b in best] == sorted((points @ q).tolist(), reverse=True)[:5]
    for (begin, end), low, high in zip(tree["span"], tree["low"], tree["high"]):
        part = tree["points"][begin:end]
        assert (part.min(0) == low).all() and (part.max(0) == high).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(none, F.col("vec_id") % 50 == 0).count() == 0
    assert permindex.nearest(none, F.col("vec_id") % 100 == 0).count() == 0


def test_permutation_index_recall(spark):
    made = rows(3000, 24, 2)
    got = collected(permindex.nearest(spark.createDataFrame(made, SCHEMA), F.col("vec_id") % 20 == 0, 10, n_pivots=128, length=48, share=0.2, shard_rows=1000, query_rows=64))
    want = brute(made, 20, 10, False)
    assert set(got) == set(want)
    hits = total = 0
    for q, (near,) in want.items():
        known = {i for i, _ in near}
        hits += len(known & {i for _, i, _ in got[q]})
        total += len(near)
        assert [r for r, *_ in got[q]] == list(range(1, len(got[q]) + 1))
        assert [(s, i) for _, i, s in got[q]] == sorted((s, i) for _, i, s in got[q])
    assert hits / total >= 0.9


def test_permutation_index_recall_with_a_third_of_copies(spark):
    made = rows(3000, 24, 7)
    # One vector a third of the rows, and one id in many rows.
    copied = np.random.default_rng(8).permutation(3000)[:1000].tolist()
    shared = made[copied[0]][1]
    for i in copied:
        made[i] = (i, shared, "a", 1)
    made += [(copied[1], shared, "c", 3)] * 15
    made = [made[i] for i in np.random.default_rng(9).permutation(len(made))]
    got = collected(permindex.nearest(spark.createDataFrame(made, SCHEMA), F.col("vec_id") % 20 == 0, 10, n_pivots=128, length=48, share=0.2, shard_rows=4000, query_rows=64))
    want = brute(made, 20, 10, False)
    assert set(got) == set(want)
    hits = total = 0
    for q, (near,) in want.items():
        hits += len({i for i, _ in near} & {i for _, i, _ in got[q]})
        total += len({i for i, _ in near})
        # Of copies none is lost: rows at distance 0 are exact.
        same = [(i, s) for i, s in near if s == 0]
        assert [(i, s) for _, i, s in got[q] if s == 0][: len(same)] == same
    assert hits / total >= 0.9


def test_pivots_are_distinct(spark):
    made = [(i, [1.0, 2.0], "", 0) for i in range(500)] + [(500 + i, [float(i), -1.0], "", 0) for i in range(30)] + [(900, [0.0, 1.0], "", 0), (901, [-0.0, 1.0], "", 0)]
    vectors = permindex.choose_pivots(spark.createDataFrame(made, SCHEMA).selectExpr("vec_id", "cast(embedding as array<double>) embedding").repartition(3), 20)[2]
    assert len(vectors) == len({tuple(v) for v in vectors.tolist()}) == 20


def test_permutation_index_is_exact_when_all_is_reranked(spark):
    made = rows(300, 6, 4)
    got = collected(permindex.nearest(spark.createDataFrame(made, SCHEMA), F.col("vec_id") % 100 == 0, 10, n_pivots=16, length=8, share=1.0))
    for q, (near,) in brute(made, 100, 10, False).items():
        assert [(i, round(s, 9)) for _, i, s in got[q]] == [(i, round(s, 9)) for i, s in near]


def test_footrule_gain():
    rng = np.random.default_rng(5)
    places = np.array([rng.permutation(9)[:4] for _ in range(50)]).astype(np.int16)
    query = rng.permutation(9)[:4]
    begins, posted, place = permindex.invert(places, 9)
    gain = permindex.footrule_gain(begins, posted, place, query, 50)
    where = lambda p, x: list(p).index(x) if x in p else 4
    footrule = np.array([sum(abs(where(query, x) - where(p, x)) for x in range(9)) for p in places])
    assert (footrule + gain == 2 * sum(4 - i for i in range(4))).all()
