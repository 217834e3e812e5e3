import hashlib
import random
import re

import numpy as np
import pytest

from loamline.llm import minhash, substring
from loamline.llm.components import components, links_within

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


def shingles(text):
    w = WORD.findall(fold(text or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 150))) for _ in range(n // 3)]
    while len(texts) < n:
        w = rng.choice(texts).split(" ")
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [None, "", " \t\n", "a b", "A  B", "a b c", "Éa b c d e", "éa b c d e", texts[0], "x " * 3000]
    return [(i, t, 1, "n") for i, t in enumerate(texts)] + [(3, texts[3], 1, "n"), (None, texts[4], 1, "n"), (None, "only here now", 1, "n")]


def components_by_hand(rows, percent=85):
    sets = [shingles(t) for _, t, *_ in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least.get(find(i)), (d == least.get(find(i))) if d is not None else least.get(find(i)) is None) for i, ((d, *_), s) in enumerate(zip(rows, sets))]


SCHEMA = "doc_id long, text string, node int, kept string"


@pytest.mark.parametrize("seed,chunks", [(1, None), (2, (3, 200))])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, seed, chunks):
    if chunks:
        monkeypatch.setattr(minhash, "BUCKET_CHUNK", chunks[0])
        monkeypatch.setattr(minhash, "CLUSTER_CHUNK", chunks[1])
        monkeypatch.setattr(minhash, "BROADCAST_ROWS", 0)
    rows = corpus(seed)
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(components_by_hand(rows), key=repr)


def test_no_documents(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(none).count() == 0 and substring.deduplicate(none).count() == 0 and substring.cleaned(none).count() == 0


def test_estimates_follow_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for share in (0.2, 0.5, 0.85, 1.0):
        for _ in range(20):
            pool = rng.integers(0, 2**63, 2000, dtype=np.int64).astype(np.uint64)
            both = int(2 * share * 1000 / (1 + share))
            a, b = pool[:1000], np.concatenate([pool[1000 - both : 1000], pool[1000 : 2000 - both]])
            one, two = (np.frombuffer(minhash.pack(minhash.minima(x)), "<u8") for x in (a, b))
            errors.append(abs(minhash.estimate(one, two[None])[0] - share))
    assert np.mean(errors) < 0.06 and max(errors) < 0.25


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(4000, 4100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_links_of_split_groups(spark):
    values = [(g, m, 1, float(v)) for g in range(3) for m, v in enumerate([0, 1, 2, 10, 11, 30, 31, 32, 33, 50])]

    def linker(block):
        v = np.array(block.column("v").to_pylist())
        return lambda row, others: np.abs(v[others] - v[row]) <= 1

    for capacity in (1, 3, 100):
        edges = links_within(spark.createDataFrame([(g, m + 100 * g, w, v) for g, m, w, v in values], "group_id long, member long, weight int, v double"), capacity, linker)
        got = {r.node: r.root for r in components(edges).collect()}
        want = {100 * g + m: 100 * g + r for g in range(3) for m, r in {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 5, 7: 5, 8: 5}.items()}
        assert got == want


def test_links_of_a_large_group_with_stragglers(spark):
    rng = random.Random(6)
    values = [float(v) for v in [*np.linspace(0, 40, 81), *(100 + 3 * i for i in range(25)), *(100.5 + 3 * i for i in range(0, 25, 2)), 40.9]]
    rng.shuffle(values)

    def linker(block):
        v = np.array(block.column("v").to_pylist())
        return lambda row, others: np.abs(v[others] - v[row]) <= 1

    rows = spark.createDataFrame([(g, 1000 * g + m, 1, v) for g in (0, 1) for m, v in enumerate(values)], "group_id long, member long, weight int, v double")
    parent = {m: m for m in range(len(values))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if abs(a - values[j]) <= 1:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    want = {1000 * g + m: 1000 * g + find(m) for g in (0, 1) for m in parent if sum(find(x) == find(m) for x in parent) > 1}
    for capacity in (4, 11, 45, 60):
        assert {r.node: r.root for r in components(links_within(rows, capacity, linker)).collect()} == want, capacity


def removed_by_hand(rows, window):
    seen, out = {}, []
    for i, (d, t, *_) in sorted(enumerate(rows), key=lambda x: -1 if x[1][0] is None else x[1][0]):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if seen.setdefault(key, (d, p)) != (d, p):
                gone[p : p + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,window,anchor", [(1, 20, 6), (2, 8, 3), (3, 6, 2), (4, 5, 5), (5, 4, 1)])
def test_removal_equals_brute_force(spark, seed, window, anchor):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(6 if window < 8 else 3000)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 60))] for _ in range(10)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += [rng.choice(vocabulary) for _ in range(rng.randint(0, 25))]
            p = rng.choice(passages)
            w += p[: rng.randint(1, len(p))] if rng.random() < 0.5 else p
        rows.append((i * 3 % 61, rng.choice([" ", "\n", " \t"]).join(w), 1, "n"))
    rows += [(100, None, 1, "n"), (101, "", 1, "n"), (102, "a " * 3000, 1, "n"), (103, "a " * 50, 1, "n"), (None, rows[0][1], 1, "n"), rows[5]]
    got = substring.deduplicate(spark.createDataFrame(rows, SCHEMA).repartition(4), window, anchor, digests=True).collect()
    assert sorted(map(tuple, got), key=repr) == removed_by_hand(rows, window)


def test_cleaned_keeps_columns_and_white_space(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, f"a\nb  c {passage}\nd", 7, "x"), (2, f"e\t\tf\n{passage} g\n\nh", 8, "y"), (3, "kept as\n it is ", 9, "z"), (4, None, 1, None)]
    got = {r.doc_id: r for r in substring.cleaned(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1] and got[4].text is None
    assert got[2].text == "e\t\tf g\n\nh" and (got[2].node, got[2].kept) == (8, "y")
    assert substring.cleaned(spark.createDataFrame(rows, SCHEMA)).columns == ["doc_id", "text", "node", "kept"]


def sentence(*numbers):
    return " ".join(f"v{n}" for n in numbers)


A, B, C = (sentence(*range(k, k + 40)) for k in (0, 1000, 2000))
D, E = sentence(*range(3000, 3040)), sentence(*range(4000, 4040))


def removed_per_row(rows, window):
    """Of every row how many words go; rows of equal doc_id and text are one document, those without a doc_id come first."""
    keys = sorted({(d is not None, d or 0, t or "") for d, t in rows})
    # Among texts of one doc_id, and among those without one, the operator's own order counts.
    out, seen = {}, {}
    for key in keys:
        w = WORD.findall(key[2])
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[p : p + window]), (key, p)) != (key, p):
                gone[p : p + window] = [True] * window
        out[key] = sum(gone)
    return out


@pytest.mark.parametrize("rows", [[(1, A), (5, A), (5, B)], [(1, A), (5, A), (5, B), (5, A)], [(None, C), (2, C), (None, D), (None, D)], [(-(1 << 63), A), (None, A), (None, E)], [(3, A)] * 3 + [(4, A + " " + B)], [(None, None), (None, ""), (None, B), (0, B)]])
def test_texts_under_one_id_keep_their_own_words(spark, rows):
    df = spark.createDataFrame([(d, t, 1, "n") for d, t in rows], SCHEMA).repartition(3)
    want = removed_per_row(rows, 20)
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring.deduplicate(df, digests=True).collect()), key=repr)
    assert got == sorted(((d, len((t or "").split()), want[d is not None, d or 0, t or ""]) for d, t in rows), key=repr)
    kept = sorted(((r.doc_id, len((r.text or "").split())) for r in substring.cleaned(df).collect()), key=repr)
    assert kept == sorted(((d, n - gone) for d, n, gone in got), key=repr)


def test_unique_texts_without_ids_lose_nothing(spark):
    rows = [(None, C, 1, "n"), (None, A + " " + A, 1, "n"), (None, D + " " + B, 1, "n"), (7, E, 1, "n"), (7, D, 1, "n")]
    got = sorted((r.n_words, r.n_removed) for r in substring.deduplicate(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect())
    assert got == [(40, 0), (40, 0), (40, 40), (80, 0), (80, 40)]


@pytest.mark.parametrize("limit", [400_000, 0])
@pytest.mark.parametrize(
    "rows,want",
    [
        ([(3, A), (7, A), (7, B)], [(3, A), (7, B)]),
        ([(3, A)] * 3, [(3, A)]),
        ([(3, A), (None, A), (None, A), (None, B), (None, B)], [(3, A), (None, B)]),
        ([(None, ""), (None, None), (4, " "), (4, " ")], [(None, ""), (None, None), (4, " "), (4, " ")]),
        ([(9, A + " x"), (8, A), (2, A + " y")], [(2, A + " y")]),
    ],
)
def test_one_row_stands_for_a_component(spark, monkeypatch, rows, want, limit):
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", limit)
    df = spark.createDataFrame([(d, t, n, "x") for n, (d, t) in enumerate(rows)], SCHEMA).repartition(2)
    got = minhash.representatives(df, 80)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)
    whole = {tuple(r) for r in df.collect()}
    assert {tuple(r) for r in got.collect()} <= whole


def test_rows_without_an_id_meet_their_own_texts(spark):
    """Copies without a doc_id are one class with one text, however many they are."""
    rows = [(None, f"{A} {n}", 1, "n") for n in range(30) for _ in range(3)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), 80).collect()
    assert len(got) == 90 and all(r.kept and r.component_id is None for r in got)
    assert minhash.representatives(spark.createDataFrame(rows, SCHEMA), 80).count() == 1
