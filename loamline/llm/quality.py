"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of the whole text is encoded (a
histogram of its bytes and hashed byte pairs, and how far its words repeat,
through a learned layer); gated attention, learned from document labels alone,
weighs the passages; the weighted sum is scored by a logistic unit.

The model is fitted on at most about ``PER_CLASS`` labelled rows of either class
(held-out rows excluded), whose features alone reach the driver. Scoring is a
map over all documents without a shuffle.

Defined cases: a null or empty text is one empty passage, scored like any other;
texts may have any length; repeated rows get the same score; an empty table
gives no row; without labels of both classes every score is the share of 1
(0.5 if there is no label at all).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.held import release, trim
from loamline.llm.labelled import held_out, training_rows
from loamline.session import ship

PER_CLASS = 1500
PASSAGE_BYTES = 512
PAIR_BINS = 256
HIDDEN, ATTENTION = 24, 12
#: Minibatches of BATCH documents, whatever the size of the sample.
STEPS, BATCH, RATE, DECAY = 1400, 64, 0.01, 1e-5
THRESHOLD = 0.3
WIDTH = 256 + PAIR_BINS + 2
#: Characters of text that are encoded at once; a longer text is encoded alone, part by part.
GROUP_BYTES = 1 << 19
_SPACE = re.compile(r"\s")


def repeats(text: str) -> float:
    """The share of a text's words that it has had before."""
    words = text.split() if len(text) <= GROUP_BYTES else None
    if words is not None:
        return 1 - len(set(words)) / len(words) if words else 0.0
    hashes, at = [np.zeros(0, np.int64)], 0
    while at < len(text):
        space = _SPACE.search(text, at + GROUP_BYTES)
        end = space.start() if space else len(text)
        hashes.append(np.fromiter(map(hash, text[at:end].split()), np.int64))
        at = end
    every = np.concatenate(hashes)
    return 1 - len(np.unique(every)) / len(every) if len(every) else 0.0


def encode(texts: list[str], shares: list[float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts (or of bytes that are whole passages of one, whose share of repeats is given), and each text's number of passages (at least one)."""
    raw = [t.encode() if isinstance(t, str) else t for t in texts]
    sizes = np.array([len(x) for x in raw], np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE_BYTES))
    data = np.frombuffer(b"".join(raw), np.uint8)
    first = np.cumsum(counts) - counts
    within = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    passage = np.repeat(first, sizes) + within // PASSAGE_BYTES
    n = int(counts.sum())
    single = np.bincount(passage * 256 + data, minlength=n * 256).reshape(n, 256)
    inside = passage[1:] == passage[:-1]
    pair = (data[:-1].astype(np.int64) * 31 + data[1:].astype(np.int64) * 17) % PAIR_BINS
    double = np.bincount(passage[1:][inside] * PAIR_BINS + pair[inside], minlength=n * PAIR_BINS).reshape(n, PAIR_BINS)
    length = np.maximum(1, single.sum(1))[:, None]
    out = np.empty((n, WIDTH), np.float32)
    out[:, :256] = np.sqrt(single / length)
    out[:, 256:-2] = np.sqrt(double / length)
    out[:, -2] = single.sum(1) / PASSAGE_BYTES
    for i, text in enumerate(texts):
        out[first[i] : first[i] + counts[i], -1] = shares[i] if shares else repeats(text)
    return out, counts


def parts_of(text: str) -> Iterator[np.ndarray]:
    """Features of a long text's passages, a bounded number at a time."""
    raw, share = text.encode(), repeats(text)
    step = GROUP_BYTES // PASSAGE_BYTES * PASSAGE_BYTES
    for begin in range(0, len(raw), step):
        yield encode([raw[begin : begin + step]], [share])[0]


class AttentionMIL:
    """h = relu(W x); a = softmax(w . (tanh(V h) * sigmoid(U h))); score = sigmoid(c . sum a h)."""

    def __init__(self, prior: float = 0.5) -> None:
        rng = np.random.default_rng(7)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {
            "W": draw(WIDTH, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION),
            "w": draw(ATTENTION), "c": draw(HIDDEN), "d": np.zeros(1, np.float32),
        }
        self.shift, self.constant = 0.0, prior
        self.fitted = False

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Hidden values, both gates' parts and attention logits of passages."""
        p = self.p
        h = np.maximum(x @ p["W"] + p["b"], 0)
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        return h, t, g, (t * g) @ p["w"]

    def long_score(self, text: str) -> float:
        """The score of a text whose passages are encoded part by part."""
        if not self.fitted:
            return self.constant
        hidden, logits = zip(*((h, e) for h, _, _, e in map(self.passages, parts_of(text))))
        h, e = np.concatenate(hidden), np.concatenate(logits)
        a = np.exp(e - e.max())
        logit = float(((a / a.sum())[:, None] * h).sum(0) @ self.p["c"] + self.p["d"][0])
        return 1 / (1 + np.exp(-(logit + self.shift)))

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        p, first, bag = self.p, np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
        h, t, g, e = self.passages(x)
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        return {"bag": bag, "first": first, "h": h, "t": t, "g": g, "a": a, "z": z, "logit": z @ p["c"] + p["d"]}

    def scores(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(counts), self.constant)
        return 1 / (1 + np.exp(-(self.forward(x, counts)["logit"].astype(np.float64) + self.shift)))

    def gradient(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, counts)
        bag, h, t, g, a = (f[k] for k in ("bag", "h", "t", "g", "a"))
        dl = (weight * (1 / (1 + np.exp(-f["logit"])) - y) / weight.sum()).astype(np.float32)
        dz = dl[:, None] * p["c"]
        da = (dz[bag] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, f["first"])[bag])
        dtg = de[:, None] * p["w"]
        dv, du = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (a[:, None] * dz[bag] + dv @ p["V"].T + du @ p["U"].T) * (h > 0)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (t * g).T @ de, "c": f["z"].T @ dl, "d": dl.sum(keepdims=True)}

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Adam over minibatches; ``weight`` undoes a sampling by class."""
        rng, first = np.random.default_rng(11), np.cumsum(counts) - counts
        m, v = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}
        order: list[int] = []
        for step in range(1, STEPS + 1):
            if len(order) < min(BATCH, len(y)):
                order = rng.permutation(len(y)).tolist()
            chosen, order = np.array(order[:BATCH]), order[BATCH:]
            rows = np.concatenate([np.arange(first[i], first[i] + counts[i]) for i in chosen])
            rate = RATE * (1 - step / STEPS)
            for k, grad in self.gradient(x[rows], counts[chosen], y[chosen], weight[chosen]).items():
                grad = grad + DECAY * self.p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        self.fitted = True


def groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about GROUP_BYTES together."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > GROUP_BYTES:
            yield begin, i
            begin, held = i, 0
        held += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> AttentionMIL:
    """A model fitted on a bounded sample of labelled rows; executors encode, the driver fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in groups(texts):
                x, counts = encode(texts[begin:end])
                ends = np.cumsum(counts)
                data = [x[b:e].astype(np.float16).tobytes() for b, e in zip(ends - counts, ends)]
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(data, pa.binary())], ["doc_id", "label", "features"])

    ship(docs.sparkSession)
    sample, counts = training_rows(docs, labels, label, per_class)
    rows = sorted(sample.mapInArrow(run, "doc_id long, label int, features binary").collect(), key=lambda r: (r.doc_id, r.features))
    total = sum(counts.values())
    model = AttentionMIL(counts.get(1, 0) / total if total else 0.5)
    y = np.array([r.label for r in rows], np.float32)
    if len(set(y.tolist())) == 2:
        features = [np.frombuffer(r.features, np.float16).reshape(-1, WIDTH) for r in rows]
        model.fit(np.concatenate(features).astype(np.float32), np.array([len(f) for f in features]), y, np.ones(len(y), np.float32))
        # The sample's share of either class isn't the labels': the logit moves by the difference of the log odds.
        model.shift = float(np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum())))
    del rows
    trim()
    return model


def batch_scores(model: AttentionMIL, texts: list[str | None]) -> np.ndarray:
    """Scores of whole texts, a bounded number of bytes at a time."""
    whole = [t or "" for t in texts]

    def scores(begin: int, end: int) -> np.ndarray:
        if end - begin == 1 and len(whole[begin]) > GROUP_BYTES:
            return np.array([model.long_score(whole[begin])])
        return model.scores(*encode(whole[begin:end]))

    return np.concatenate([np.zeros(0), *(scores(begin, end) for begin, end in groups(whole))])


def score(docs: DataFrame, model: AttentionMIL, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(batch_scores(model, batch.column(1).to_pylist()))], ["doc_id", "score"])

    ship(docs.sparkSession)
    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: AttentionMIL, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            yield batch.filter(pa.array(batch_scores(model, batch.column(at).to_pylist()) >= threshold))

    ship(docs.sparkSession)
    at = docs.columns.index("text")
    return docs.mapInArrow(run, docs.schema)
