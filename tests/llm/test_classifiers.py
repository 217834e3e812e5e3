import random
import zlib
from collections import Counter

import numpy as np
import pytest

from loamline.llm import quality, toxicity

SCHEMA = "doc_id long, text string, score string, label int"


def corpus(n=700, seed=1):
    """Clean prose, prose with insults, junk."""
    rng = random.Random(seed)
    words = [a + b + c for a in ("ba", "ko", "ri", "su") for b in ("n", "m", "t") for c in ("a", "e", "i", "o")]
    insults = ["grobbel", "snork", "flitz"]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(5, 200))]
        toxic, good = int(rng.random() < 0.2), int(rng.random() < 0.7)
        if toxic:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(insults) + rng.choice(["", ",", "!"]))
        if not good:
            w = [x + rng.choice(["###", "%%", "|"]) for x in w]
        docs.append((i, " ".join(w), "x", 3))
        labels.append((i, good, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    odd = [(9000, None, "x", 3), (9001, "", "x", 3), (9002, "grobbel snork " * 40_000, "x", 3), (None, "snork banа", "x", 3), (9003, "123 456", "x", 3), docs[0]]
    return (
        spark.createDataFrame(docs + odd, SCHEMA).repartition(3),
        spark.createDataFrame(labels + [(9500, 1, 0), (None, 1, 1), (9001, None, None)], "doc_id long, quality int, toxic int"),
        {i: (q, t) for i, q, t in labels},
        len(docs) + len(odd),
    )


@pytest.mark.parametrize("module,place,threshold", [(quality, 0, 0.3), (toxicity, 1, 0.5)])
def test_held_out_accuracy(spark, tables, module, place, threshold):
    docs, labels, known, n = tables
    model = module.train(docs, labels, per_class=400)
    rows = module.score(docs, model).collect()
    assert len(rows) == n
    right = total = 0
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.held_out and r.doc_id in known:
            total += 1
            right += r.predicted == known[r.doc_id][place]
    assert total > 50 and right / total > 0.95
    kept = module.accepted(docs, model).collect()
    wanted = sum((r.predicted == 1) == (module is quality) for r in rows)
    assert len(kept) == wanted and kept[0].score == "x" and kept[0].label == 3
    by = {r.doc_id: r for r in rows}
    if module is toxicity:
        assert by[9002].predicted == 1 and by[9001].predicted == by[9000].predicted == 0 and by[9000].score == by[9003].score
        assert by[9002].evidence and all(0 < e.cosine <= 1 + 1e-9 for e in by[9002].evidence)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_held_out_labels_teach_nothing(spark, tables, module):
    docs, labels, known, _ = tables
    from loamline.llm.labelled import held_out

    label = "quality" if module is quality else "toxic"
    other = labels.withColumn(label, (1 - labels[label] if True else 0).cast("int")).filter(held_out()).unionByName(labels.filter(~held_out()))
    a = {r.doc_id: r.score for r in module.score(docs, module.train(docs, labels, per_class=300)).collect()}
    b = {r.doc_id: r.score for r in module.score(docs, module.train(docs, other, per_class=300)).collect()}
    assert a == b


@pytest.mark.parametrize("module", [quality, toxicity])
def test_without_documents_or_labels(spark, tables, module):
    docs, labels, _, n = tables
    none = spark.createDataFrame([], SCHEMA)
    assert module.score(none, module.train(none, labels)).count() == 0
    rows = module.score(docs, module.train(docs, labels.limit(0))).collect()
    assert len(rows) == n and len({r.score for r in rows}) == 1


def test_block_max_index_is_exact():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(500):
        terms = rng.choice(60, rng.integers(1, 6), replace=False).tolist()
        w = rng.random(len(terms)) + 0.01
        vectors.append(dict(zip(terms, (w / np.sqrt((w * w).sum())).tolist())))
    vectors += vectors[:30]
    index = toxicity.BlockMaxIndex(vectors, 60)
    for q in vectors[::17]:
        every = [(-sum(w * v.get(t, 0) for t, w in q.items()), i) for i, v in enumerate(vectors)]
        want = sorted((round(s, 12), i) for s, i in every if s < 0)[:10]
        got = [(round(-s, 12), i) for s, i in index.top(q, 10)]
        assert [s for s, _ in got] == [s for s, _ in want]
        assert [i for s, i in got if s < want[-1][0]] == [i for s, i in want if s < want[-1][0]]


def test_rare_words_and_small_samples_keep_a_vocabulary(spark):
    """Words of few toxic examples, and examples without any toxic word, are searched."""
    rng = random.Random(5)
    prose = ["bana", "kone", "rimi", "suta", "bati", "koma", "rinu", "sumo"]
    docs = [(i, " ".join(rng.choice(prose) for _ in range(20)) + (f" zwiff{i % 3} quarx" if i < 12 else ""), "x", 3) for i in range(150)]
    labels = [(i, 1, int(i < 12)) for i in range(150)]
    docs += [(1000 + i, " ".join(rng.choice(prose) for _ in range(20)) + f" zwiff{i} quarx", "x", 3) for i in range(3)]
    docs += [(2000, "bana kone rimi", "x", 3)]
    table = spark.createDataFrame(docs, SCHEMA)
    model = toxicity.train(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {"quarx", *prose} <= set(model.terms)
    by = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    assert all(by[1000 + i].predicted == 1 for i in range(3)) and by[2000].predicted == 0
    assert len(by[2000].evidence) == toxicity.NEIGHBOURS


def test_attention_gradient():
    texts = ["abc def " * 100, "xyz", "", "hello there " * 60]
    x, counts = quality.encode(texts)
    assert counts.tolist() == [2, 1, 1, 2] and len(x) == 6
    model = quality.AttentionMIL()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    model.p["b"] += 0.1  # away from the kink at which an empty text lies
    y, w = np.array([1, 0, 1, 0.0]), np.ones(4)
    gradient = model.gradient(x.astype(np.float64), counts, y, w)

    def loss():
        logit = model.forward(x.astype(np.float64), counts)["logit"]
        return float(np.mean(np.logaddexp(0, logit) - y * logit))

    rng = np.random.default_rng(0)
    for name, value in model.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in value.shape)
            kept = value[at]
            value[at] = kept + 1e-5
            up = loss()
            value[at] = kept - 1e-5
            down = loss()
            value[at] = kept
            assert abs((up - down) / 2e-5 - gradient[name][at]) < 1e-5, name


def test_whole_texts_count():
    """A word at the very end of a long text is seen by both."""
    assert toxicity.words("a " * 100_000 + "Snork!")[-1] == "snork"
    x, counts = quality.encode(["a" * 10_000 + "%" * 100])
    assert counts[0] == 20 and x[-1, ord("%")] > 0
    assert Counter(toxicity.words("Ünter_x9 y")) == Counter(["ünter", "x", "y"])


def dense_scores(rows, labels, k):
    """Cosines of all texts to all examples in one dense matrix; {doc_id: (score, neighbours' cosines)}."""
    bags = {}
    for d, t, *_ in rows:
        bags.setdefault(d, Counter(toxicity.words(t or "")))
    examples = sorted(d for d, *_ in labels if d in bags and zlib.crc32(str(d).encode()) % 5)
    kind = {d: c for d, _, c in labels}
    vocabulary = sorted({w for d in examples for w in bags[d]})
    seen = np.array([sum(w in toxicity.words(t or "") for _, t, *_ in rows) for w in vocabulary])
    voices = {c: {toxicity.fingerprint(dict((r[0], r[1]) for r in reversed(rows))[d] or "") for d in examples if kind[d] == c} for c in (0, 1)}
    text = dict((r[0], r[1] or "") for r in reversed(rows))
    ratio = []
    for w in vocabulary:
        a, b = (len({toxicity.fingerprint(text[d]) for d in examples if kind[d] == c and w in bags[d]}) for c in (1, 0))
        ratio.append(toxicity.likelihood_ratio(np.array([a]), np.array([b]), len(voices[1]), len(voices[0]))[0])
    weight = (np.log((1 + len(rows)) / (1 + seen)) + 1) * np.sqrt(1 + np.array(ratio))

    def vector(bag):
        v = np.array([(1 + np.log(bag[w])) * x if bag[w] else 0.0 for w, x in zip(vocabulary, weight)])
        return v / np.linalg.norm(v) if v.any() else v

    matrix = np.array([vector(bags[d]) for d in examples])
    n = {c: sum(kind[d] == c for d in examples) for c in (0, 1)}
    total = {c: sum(x == c for d, _, x in labels if d is not None and zlib.crc32(str(d).encode()) % 5) for c in (0, 1)}
    prior = total[1] / (total[0] + total[1])
    # Equal vectors are one entry with all their votes.
    groups, votes = [], []
    for row, d in zip(matrix, examples):
        place = next((i for i, g in enumerate(groups) if np.array_equal(g, row)), None)
        if place is None:
            place = len(groups)
            groups.append(row)
            votes.append([0.0, 0.0])
        votes[place][kind[d]] += total[kind[d]] / n[kind[d]]
    groups, votes = np.array(groups), np.array(votes)

    def share(v, less=None):
        cosine = groups @ v
        near = [i for i in np.lexsort((np.arange(len(cosine)), -np.round(cosine, 12)))[:k] if cosine[i] > 0]
        w = 1 / (np.maximum(0, 1 - cosine[near]) + toxicity.SMOOTH)
        own = votes[near].copy()
        if less:
            own[[i for i, x in enumerate(near) if np.array_equal(groups[x], v)], less[0]] -= less[1]
        clean, toxic = w @ own
        return np.log((toxic + prior) / (clean + 1 - prior)), cosine[near]

    x = np.array([share(row, (kind[d], total[kind[d]] / n[kind[d]]))[0] for row, d in zip(matrix, examples)])
    curve = toxicity.logistic(x, np.array([kind[d] for d in examples], float), np.array([total[kind[d]] / n[kind[d]] for d in examples]))
    out = {}
    for d, bag in bags.items():
        v = vector(bag)
        if v.any():
            found, cosines = share(v)
            out[d] = 1 / (1 + np.exp(-(curve[0] * found + curve[1]))), cosines
    return out


def test_toxicity_equals_dense_brute_force(spark):
    rng = random.Random(11)
    words = [a + b + c for a in ("ba", "ko", "ri") for b in ("n", "m", "t") for c in ("a", "e", "i", "o")]
    rows, labels = [], []
    for i in range(240):
        toxic = int(i % 5 == 1)
        w = [rng.choice(words) for _ in range(rng.randint(4, 60))] + [f"own{chr(97 + i % 26)}{chr(97 + i // 26)}"] + ["snork", "flitz"][: toxic * rng.randint(1, 2)]
        rows.append((i, " ".join(w), "x", 3))
        labels.append((i, 1, toxic))
    rows += [(1000, None, "x", 3), (1001, "nothing known", "x", 3), (1002, "snork", "x", 3), rows[3], (1003, rows[6][1], "x", 3)]
    table, marked = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(table, marked)
    want = dense_scores(rows, labels, toxicity.NEIGHBOURS)
    got = toxicity.score(table, model).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in want:
            score, cosines = want[r.doc_id]
            assert abs(r.score - score) < 1e-6 and np.allclose([e.cosine for e in r.evidence], cosines, atol=1e-9), r.doc_id
        else:
            assert r.evidence == [] and r.score == model.none
    assert set(want) == {r[0] for r in rows} - {1000, 1001}


def test_blocks_are_skipped():
    rng = np.random.default_rng(4)
    # Groups of entries with a heavy term of their own, and frequent light ones.
    vectors = []
    for i in range(2000):
        terms = np.array([100 + i // 100, *rng.choice(20, 5, replace=False)])
        w = np.array([3.0, *rng.random(5)])
        vectors.append((terms, w / np.sqrt((w * w).sum())))
    index = toxicity.BlockMaxIndex(vectors, 200)
    for batch in (vectors[::31], vectors[5:6]):
        index.read = 0
        got = index.top_many(batch, 10)
        assert index.read < 0.3 * len(batch) * index.blocks
        for (terms, weights), found in zip(batch, got):
            every = sorted(((-sum(w * dict(zip(*v)).get(t, 0) for t, w in zip(terms, weights)), i) for i, v in enumerate(vectors)))[:10]
            assert np.allclose([-s for s, _ in every], found[0], atol=1e-12)


def test_a_doc_id_is_one_example(spark):
    from loamline.llm.labelled import training_rows

    docs = spark.createDataFrame([(1, "b", "x", 3)] * 500 + [(1, "a", "x", 3), (2, "c", "x", 3), (3, "d" * 300_000, "x", 3)], SCHEMA)
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    rows = training_rows(docs, labels, "toxic", 10)[0].collect()
    assert {(r.doc_id, r.text, r.label) for r in rows} <= {(1, "a", 1), (2, "c", 0)} and len(rows) == len({r.doc_id for r in rows})


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = "ΑΣ ΌΣΟΣ aΣ " * 50 + "x1y " * 30
    whole = toxicity.bag(text)
    monkeypatch.setattr(toxicity, "PIECE", 7)
    assert toxicity.bag(text) == whole == Counter(toxicity.words(text))


def test_quality_equals_one_document_at_a_time(spark, tables):
    """Gated attention written out for one document, passage by passage."""
    docs, labels, _, _ = tables
    model = quality.train(docs, labels, per_class=200)
    p = {k: v.astype(np.float64) for k, v in model.p.items()}

    def by_hand(text):
        raw, w = (text or "").encode(), (text or "").split()
        repeats = 1 - len(set(w)) / len(w) if w else 0
        hidden, gates = [], []
        for at in range(0, max(1, len(raw)), quality.PASSAGE_BYTES):
            part = raw[at : at + quality.PASSAGE_BYTES]
            x = np.zeros(quality.WIDTH)
            for c in part:
                x[c] += 1
            for c, d in zip(part, part[1:]):
                x[256 + (c * 31 + d * 17) % quality.PAIR_BINS] += 1
            x = np.sqrt(x / max(1, len(part)))
            x[-2], x[-1] = len(part) / quality.PASSAGE_BYTES, repeats
            h = np.maximum(x @ p["W"] + p["b"], 0)
            hidden.append(h)
            gates.append(p["w"] @ (np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))))
        a = np.exp(np.array(gates) - max(gates))
        z = (a / a.sum()) @ np.array(hidden)
        return 1 / (1 + np.exp(-(z @ p["c"] + p["d"][0] + model.shift)))

    text = {}
    for r in docs.collect():
        text.setdefault(r.doc_id, r.text)
    for r in quality.score(docs, model).collect():
        assert abs(r.score - by_hand(text[r.doc_id])) < 1e-4, r.doc_id
