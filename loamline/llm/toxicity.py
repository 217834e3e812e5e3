"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

The fitted part is an index of at most about ``PER_CLASS`` labelled examples of
either class (held-out rows excluded, none over ``labelled.MOST_BYTES``) over all of
their words. A word weighs its TF-IDF times sqrt(1 + G): document frequencies are those
of all documents, and G is the word's log-likelihood ratio between the classes of
the examples, so no word is lighter than in TF-IDF, and words whose classes differ are
heavier. Sums in single precision with a margin for their rounding choose the
candidates, whose cosines are then taken in double precision. Words are told apart by
64-bit hashes.

Examples with the same vector are one entry that counts its votes. The index is an
inverted one: the postings of rare words lie one behind another, those of words
that many entries have lie in blocks of ``BLOCK`` entries. A block is bounded by its
entries' sums over rare words and by the largest weight that each frequent word has
in it. The blocks with the best bounds are read first, then those whose bound
reaches the k-th cosine, so the neighbours are exact.

Neighbours vote with weight 1 / (distance + SMOOTH), corrected for the sampling
by class; a logistic curve fitted on the examples' leave-one-out votes turns the
share of toxic votes into a calibrated score. The neighbours are the evidence.

Scoring is a map over all documents without a shuffle; the index has a bounded
size. Defined cases: a text without any word of the vocabulary, null and empty
ones included, gets the smoothed toxic share of such examples and no evidence; texts
may have any length; repeated rows get the same score, and a doc_id that stands
several times is one example, by its smallest text; an empty table gives no row;
without labels of both classes every score is the share of 1 (0 without labels).
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm.held import held, trim
from loamline.llm.labelled import held_out, training_rows
from loamline.llm.wordhash import HashTable, hash_letters, hash_runs, hash_words
from loamline.session import ship

PER_CLASS = 4000
NEIGHBOURS, BLOCK, SMOOTH = 25, 64, 0.05
#: A word is frequent if one in so many entries has it.
FREQUENT = 20
#: Blocks that are read before any k-th cosine is known, and queries that are searched together.
FIRST_BLOCKS, TOGETHER = 4, 32
THRESHOLD = 0.5
REMEMBERED = 20_000
#: Characters of a text whose words are listed at once.
PIECE = 1 << 18

_WORD = re.compile(r"[^\W\d_]+")
_SPACE = re.compile(r"\s")

#: Terms and weights, side by side or as a dictionary.
Vector = tuple[np.ndarray, np.ndarray] | dict[int, float]
#: Cosines, largest first, and entries.
Found = tuple[np.ndarray, np.ndarray]


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def pieces(text: str | None) -> Iterator[str]:
    """The text, if it is long in pieces that end at white space."""
    at = 0
    while text and at < len(text):
        space = _SPACE.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end


def bag(text: str | None) -> Counter:
    """How often a text has each of its words."""
    found = Counter()
    for piece in pieces(text):
        found.update(words(piece))
    return found


def counted_terms(texts: list[str | None], vocabulary: HashTable) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ascending numbers of each text's words of the vocabulary, and how often it has them."""
    keys, held, owner = [np.zeros(0, np.int64)], [], []
    size = len(vocabulary.numbers)

    def flush() -> None:
        if held:
            hashes, of = hash_letters(held)
            number = vocabulary.find(hashes)
            keys.append((np.array(owner, np.int64)[of] * size + number)[number >= 0])
            held.clear()
            owner.clear()

    for i, text in enumerate(texts):
        for piece in pieces(text):
            held.append(piece)
            owner.append(i)
            if sum(map(len, held)) >= PIECE:
                flush()
    flush()
    key, times = np.unique(np.concatenate(keys), return_counts=True)
    edge = np.searchsorted(key, np.arange(len(texts) + 1) * size)
    key %= size
    return [(key[b:e], times[b:e]) for b, e in zip(edge[:-1].tolist(), edge[1:].tolist())]


def spread(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of some ranges, one behind another, and the ranges' lengths."""
    lengths = ends - begins
    return np.repeat(begins - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum()), lengths


def sides(vector: Vector) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(vector, dict):
        return np.fromiter(vector, np.int64, len(vector)), np.fromiter(vector.values(), float, len(vector))
    return vector


class BlockMaxIndex:
    """Unit vectors: postings of rare terms, and blocks of frequent ones with their largest weights."""

    def __init__(self, vectors: list[Vector], n_terms: int) -> None:
        vectors = [sides(v) for v in vectors]
        sizes = np.array([len(t) for t, _ in vectors], np.int64)
        self._fill(sizes, np.concatenate([np.zeros(0, np.int32), *(t for t, _ in vectors)]), np.concatenate([np.zeros(0), *(w for _, w in vectors)]), n_terms)

    @classmethod
    def of(cls, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int) -> BlockMaxIndex:
        """The same of vectors that lie one behind another."""
        self = cls.__new__(cls)
        self._fill(sizes, terms, weights, n_terms)
        return self

    def _fill(self, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int) -> None:
        self.n, self.blocks = len(sizes), -(-len(sizes) // BLOCK)
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        self.terms, self.weights, self.n_terms = terms.astype(np.int32), weights, n_terms
        seen = np.bincount(self.terms, minlength=n_terms)
        frequent = np.flatnonzero(seen * FREQUENT > self.n)
        self.column = np.full(n_terms, -1, np.int32)
        self.column[frequent] = np.arange(len(frequent))
        rows = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        column = self.column[self.terms]
        in_block = column >= 0
        self.dense = np.zeros((len(frequent), self.blocks * BLOCK), np.float32)
        self.dense[column[in_block], rows[in_block]] = self.weights[in_block]
        self.maxima = self.dense.reshape(len(frequent), self.blocks, BLOCK).max(2)
        rare = np.flatnonzero(~in_block)
        rare = rare[np.argsort(self.terms[rare], kind="stable")]
        self.posted, self.posted_weights = rows[rare], self.weights[rare].astype(np.float32)
        self.first = np.searchsorted(self.terms[rare], np.arange(n_terms + 1)).astype(np.int32)
        # What a sum of products of unit vectors can lose in single precision.
        self.slack = (len(frequent) + 64) * 2.0**-23
        self.read = 0

    def top(self, vector: Vector, k: int) -> list[tuple[float, int]]:
        return list(zip(*(x.tolist() for x in self.top_many([vector], k)[0])))

    def top_many(self, vectors: list[Vector], k: int) -> list[Found]:
        """For each vector the k largest (cosine, entry) of entries with a common term; ties go to the earlier entry."""
        out: list[Found] = []
        for begin in range(0, len(vectors), TOGETHER):
            out += self._top(vectors[begin : begin + TOGETHER], k)
        return out

    def _top(self, vectors: list[Vector], k: int) -> list[Found]:
        vectors, n, width = [sides(v) for v in vectors], len(vectors), self.blocks * BLOCK
        if not self.blocks:
            return [(np.zeros(0), np.zeros(0, np.int64)) for _ in vectors]
        wanted = np.zeros((n, len(self.dense)), np.float32)
        terms, weights = (np.concatenate(x) for x in zip(*vectors))
        query, column = np.repeat(np.arange(n), [len(t) for t, _ in vectors]), self.column[terms]
        in_block = column >= 0
        wanted[query[in_block], column[in_block]] = weights[in_block]
        few = terms[~in_block]
        places, lengths = spread(self.first[few].astype(np.int64), self.first[few + 1].astype(np.int64))
        products = np.repeat(weights[~in_block].astype(np.float32), lengths) * self.posted_weights[places]
        scores = np.bincount(np.repeat(query[~in_block] * width, lengths) + self.posted[places], products, n * width).astype(np.float32).reshape(n, width)
        bounds = (scores.reshape(n, self.blocks, BLOCK).max(2) + wanted @ self.maxima) * (1 + self.slack) + self.slack
        first = np.zeros((n, self.blocks), bool)
        np.put_along_axis(first, np.argpartition(-bounds, min(FIRST_BLOCKS, self.blocks) - 1, axis=1)[:, :FIRST_BLOCKS], True, axis=1)
        known = np.zeros((n, width), bool)
        self._add(wanted, scores, known, first)
        enough = min(k, width)

        def kth() -> np.ndarray:
            return -np.partition(np.where(known, -scores, np.inf), enough - 1, axis=1)[:, enough - 1]

        # Too few entries so far bound nothing.
        least = np.maximum(np.where(np.isfinite(at := kth()), at, 0.0), 0.0)
        self._add(wanted, scores, known, ~first & (bounds >= least[:, None] - self.slack))
        least = np.maximum(np.where(np.isfinite(at := kth()), at, 0.0), 0.0) - 2 * self.slack
        near = known & (scores >= least[:, None]) & (scores > 0)
        near[:, self.n :] = False
        own, out = np.zeros(self.n_terms), []
        for i, (terms, weights) in enumerate(vectors):
            entries = np.flatnonzero(near[i])
            own[terms] = weights
            places, lengths = spread(self.begin[entries], self.begin[entries + 1])
            products = np.append(own[self.terms[places]] * self.weights[places], 0.0)
            exact = np.add.reduceat(products, np.cumsum(lengths) - lengths) if len(entries) else products[:0]
            own[terms] = 0.0
            entries, exact = entries[exact > 0], exact[exact > 0]
            best = np.lexsort((entries, -exact))[:k]
            out.append((exact[best], entries[best]))
        return out

    def _add(self, wanted: np.ndarray, scores: np.ndarray, known: np.ndarray, chosen: np.ndarray) -> None:
        """Read the chosen blocks of frequent terms of each query."""
        self.read += int(chosen.sum())
        for block in np.flatnonzero(chosen.any(0)).tolist():
            rows, there = np.flatnonzero(chosen[:, block]), slice(block * BLOCK, (block + 1) * BLOCK)
            scores[rows, there] += wanted[rows] @ self.dense[:, there]
            known[rows, there] = True


class NearestExamples:
    """Vocabulary, index, votes and calibration."""

    def __init__(self, prior: float) -> None:
        self.prior = self.none = prior
        self.words = pa.array([], pa.string())
        self.key, self.known, self.index, self.vocabulary = uuid.uuid4().hex, {}, None, None

    @property
    def terms(self) -> list[str]:
        """The words of the vocabulary."""
        return sorted({w for joined in self.words.to_pylist() for w in joined.split()})

    def __getstate__(self) -> dict:
        """What executors need to build the index again; the words themselves stay here."""
        return {k: v for k, v in self.__dict__.items() if k not in ("words", "known", "index", "vocabulary")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, words=pa.array([], pa.string()))
        self.index, self.vocabulary, self.known = held("toxicity", self.key, self.built)

    def built(self) -> tuple[BlockMaxIndex | None, HashTable | None, dict]:
        if not hasattr(self, "hashes"):
            return None, None, {}
        weights = (1 + np.log(self.entry_times.astype(float))) * self.weight[self.entry_terms]
        norms = np.sqrt(np.add.reduceat(weights * weights, np.cumsum(self.sizes) - self.sizes))
        weights /= np.repeat(norms, self.sizes)
        return BlockMaxIndex.of(self.sizes, self.entry_terms, weights, len(self.weight)), HashTable(self.hashes), {}

    def vector(self, terms: np.ndarray, times: np.ndarray) -> Vector:
        weights = (1 + np.log(times.astype(float))) * self.weight[terms]
        return terms, weights / math.sqrt(weights @ weights)

    def fit(self, spark: SparkSession, words: pa.StringArray, hashes: np.ndarray, weight: np.ndarray, examples: list[tuple[int, int, np.ndarray, np.ndarray]], shares: dict[int, float], none: float) -> None:
        """``words``: those of each example; ``examples``: (doc_id, label, ascending terms, times); ``shares``: sampled share of either class."""
        self.words, self.hashes, self.weight, self.none = words, hashes, weight, none
        votes: dict[bytes, list] = {}
        keys = []
        for doc_id, label, ids, times in examples:
            keys.append(xxhash.xxh3_128_digest(ids.tobytes() + times.tobytes()))
            entry = votes.setdefault(keys[-1], [0.0, 0.0, doc_id, ids, times])
            entry[label] += 1 / shares[label]

        def heaviest(item: tuple[bytes, list]) -> tuple:
            ids = item[1][3]
            return tuple(ids[np.argsort(-weight[ids], kind="stable")[:4]].tolist()), item[0]

        # Entries with the same heavy terms lie together, so that blocks are tight.
        ordered = sorted(votes.items(), key=heaviest)
        self.sizes = np.array([len(v[3]) for _, v in ordered])
        self.entry_terms, times = (np.concatenate([v[i] for _, v in ordered]) for i in (3, 4))
        self.entry_times = times.astype(np.min_scalar_type(int(times.max())))
        self.votes = np.array([v[:2] for _, v in ordered])
        self.doc_ids = np.array([v[2] for _, v in ordered], np.int64)
        near = self.neighbours_of_entries(spark)
        place = {key: i for i, (key, _) in enumerate(ordered)}
        x, y, w = [], [], []
        for key, (_, label, _, _) in zip(keys, examples):
            me = place[key]
            self.votes[me, label] -= 1 / shares[label]
            x.append(self._share(near[me]))
            self.votes[me, label] += 1 / shares[label]
            y.append(label)
            w.append(1 / shares[label])
        self.curve = logistic(np.array(x), np.array(y, float), np.array(w))

    def neighbours_of_entries(self, spark: SparkSession) -> list[Found]:
        """Each entry's nearest entries; executors build the index and search."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = self.index
            for batch in batches:
                for begin in range(0, batch.num_rows, TOGETHER):
                    part = batch.slice(begin, TOGETHER)
                    spans = [slice(index.begin[i], index.begin[i + 1]) for i in part.column(0).to_pylist()]
                    found = index.top_many([(index.terms[x], index.weights[x]) for x in spans], NEIGHBOURS)
                    columns = [pa.array([f[i].tobytes() for f in found], pa.binary()) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["id", "cosines", "entries"])

        rows = spark.range(0, len(self.sizes), 1, spark.sparkContext.defaultParallelism).mapInArrow(run, "id long, cosines binary, entries binary").toArrow().sort_by("id")
        pairs = zip(rows.column("cosines").to_pylist(), rows.column("entries").to_pylist())
        return [(np.frombuffer(c, float), np.frombuffer(e, np.int64)) for c, e in pairs]

    def _share(self, found: Found) -> float:
        """Log odds of toxic votes, smoothed by one vote at the prior."""
        clean, toxic = (1 / (np.maximum(0.0, 1 - found[0]) + SMOOTH)) @ self.votes[found[1]]
        return math.log((toxic + self.prior) / (clean + 1 - self.prior))

    def found(self, texts: list[str | None]) -> list[Found | None]:
        """Cosines and entries of each text's nearest examples; None for a text without words of the vocabulary."""
        out: list[Found | None] = [None] * len(texts)
        if self.index is None:
            return out
        counted = counted_terms(texts, self.vocabulary)
        places = [i for i, (terms, _) in enumerate(counted) if len(terms)]
        vectors = [self.vector(*counted[i]) for i in places]
        for i, found in zip(places, self.index.top_many(vectors, NEIGHBOURS)):
            out[i] = found
        return out

    def scored(self, found: Found | None) -> float:
        if found is None:
            return self.none
        return 1 / (1 + math.exp(-(self.curve[0] * self._share(found) + self.curve[1])))

    def verdicts(self, texts: list[str | None]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Of each text the score and what it rests on: cosines and doc_ids of the nearest examples. Texts met before are remembered."""
        keys = [xxhash.xxh3_128_digest((t or "").encode()) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = {k: t for k, t in zip(keys, texts) if k not in self.known}
        for key, found in zip(new, self.found(list(new.values()))):
            cosines, entries = found or (np.zeros(0), np.zeros(0, np.int64))
            self.known[key] = self.scored(found), cosines, self.doc_ids[entries] if len(entries) else entries
        return [self.known[k] for k in keys]


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic curve, by Newton's method with a small ridge."""
    a = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    w = w / w.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ a, -30, 30)))
        gradient = design.T @ (w * (p - y)) + 1e-2 * (a - np.array([1.0, 0.0]))
        hessian = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        a -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(a[0]), float(a[1])


def fingerprint(text: str) -> int:
    """The smallest hash of three words in a row: near copies share it as often as they agree, other texts hardly ever."""
    hashes = hash_words([text.encode()], fold=True)[0]
    return int(hash_runs(hashes, min(3, len(hashes))).min() >> np.uint64(1)) if len(hashes) else 0


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part, columns = batch.slice(begin, 256), [[], [], [], []]
            for text in part.column(1).to_pylist():
                found = bag(text)
                joined = " ".join(found)
                values = fingerprint(text), joined, hash_letters([joined])[0].tobytes(), np.fromiter(found.values(), np.int32).tobytes()
                for column, value in zip(columns, values):
                    column.append(value)
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *arrays], ["doc_id", "label", "print", "words", "hashes", "times"])


def likelihood_ratio(a: np.ndarray, b: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """How far the shares a / n1 and b / n0 are from equal (G, twice the log-likelihood ratio)."""
    total = np.zeros(len(a))
    for here, n in ((a, n1), (b, n0)):
        share = (a + b) / (n1 + n0)
        for seen, expected in ((here, n * share), (n - here, n * (1 - share))):
            total += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-300)), 0.0)
    return np.maximum(total, 0.0)


def document_frequencies(docs: DataFrame, hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many rows of ``docs`` each word of the vocabulary is, and how many rows there are. As many numbers as words reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, seen, rows = HashTable(hashes), np.zeros(n_terms, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for begin in range(0, batch.num_rows, TOGETHER):
                found = counted_terms(batch.column(0).slice(begin, TOGETHER).to_pylist(), vocabulary)
                np.add.at(seen, np.concatenate([t for t, _ in found]), 1)
        there = np.flatnonzero(seen)
        numbers = np.append(there, -1), np.append(seen[there], rows)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in numbers], ["term", "n"])

    n_terms = len(hashes)
    # Partitions add up before the shuffle; rows themselves are counted as term -1.
    counts = docs.select(F.col("text").cast("string")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    found, term, n = np.zeros(n_terms, np.int64), np.asarray(counts.column("term")), np.asarray(counts.column("n"))
    found[term[term >= 0]] = n[term >= 0]
    return found, int(n[term < 0].sum())


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> NearestExamples:
    """Vocabulary, index and calibration from a bounded sample of labelled rows, document frequencies from all rows."""
    ship(docs.sparkSession)
    sample, counts = training_rows(docs, labels, label, per_class)
    total = sum(counts.values())
    model = NearestExamples(counts.get(1, 0) / total if total else 0.0)
    found = sample.mapInArrow(_counted, "doc_id long, label int, print long, words string, hashes binary, times binary").toArrow()
    kinds = np.asarray(found.column("label"))
    n = {c: int((kinds == c).sum()) for c in (0, 1)}
    if not (n[0] and n[1]):
        return model
    order = np.argsort(np.asarray(found.column("doc_id")))
    kinds, prints, doc_ids = kinds[order], np.asarray(found.column("print"))[order], np.asarray(found.column("doc_id"))[order].tolist()
    times = [np.frombuffer(x, np.int32) for x in found.column("times").to_pylist()]
    sizes, times = np.array([len(times[i]) for i in order]), np.concatenate([times[i] for i in order])
    parts = found.column("hashes").to_pylist()
    # The vocabulary is bounded by the words of the sample.
    hashes, ids = np.unique(np.frombuffer(b"".join([parts[i] for i in order]), np.uint64), return_inverse=True)
    if not len(hashes):
        return model
    ids, words = ids.astype(np.int32), found.column("words").combine_chunks()
    del found, parts
    owner = np.repeat(np.arange(len(sizes)), sizes)
    # Copies of one text are one witness for its words.
    _, witness = np.unique(np.stack([kinds.astype(np.int64), prints]), axis=1, return_inverse=True)
    voices = [len(np.unique(witness[kinds == c])) for c in (0, 1)]
    pairs = np.unique(ids.astype(np.int64) * (int(witness.max()) + 1) + witness[owner])
    kind_of = np.zeros(int(witness.max()) + 1, np.int64)
    kind_of[witness] = kinds
    of_term, is_toxic = pairs // len(kind_of), kind_of[pairs % len(kind_of)]
    a, b = (np.bincount(of_term[is_toxic == c], minlength=len(hashes)).astype(float) for c in (1, 0))
    del pairs, of_term, is_toxic, owner, witness, kind_of
    seen, rows = document_frequencies(docs, hashes)
    weight = (np.log((1 + rows) / (1 + np.minimum(seen, rows))) + 1) * np.sqrt(1 + likelihood_ratio(a, b, float(voices[1]), float(voices[0])))
    shares = {c: n[c] / counts[c] for c in (0, 1)}
    examples, ends, without = [], np.cumsum(sizes), {0: 0.0, 1: 0.0}
    for i, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist())):
        c = int(kinds[i])
        if not size:
            without[c] += 1 / shares[c]
            continue
        mine = np.argsort(ids[end - size : end])
        examples.append((doc_ids[i], c, ids[end - size : end][mine], times[end - size : end][mine]))
    none = (without[1] + model.prior) / (without[0] + without[1] + 1)
    del ids, times
    model.fit(docs.sparkSession, words, hashes, weight, examples, shares, none)
    del examples
    trim()
    return model


def score(docs: DataFrame, model: NearestExamples, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence, the nearest examples' (cosine, doc_id), of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(begin, TOGETHER)
                found = model.verdicts(part.column(1).to_pylist())
                ends = pa.array(np.concatenate([[0], np.cumsum([len(c) for _, c, _ in found])]), pa.int32())
                near = [pa.array(np.concatenate([f[i] for f in found])) for i in (1, 2)]
                evidence = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(near, ["cosine", "doc_id"]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.float64()), evidence], ["doc_id", "score", "evidence"])

    ship(docs.sparkSession)
    schema = "doc_id long, score double, evidence array<struct<cosine:double,doc_id:bigint>>"
    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def accepted(docs: DataFrame, model: NearestExamples, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(begin, TOGETHER)
                yield part.filter(pa.array([v[0] < threshold for v in model.verdicts(part.column(at).to_pylist())], pa.bool_()))

    ship(docs.sparkSession)
    at = docs.columns.index("text")
    return docs.mapInArrow(run, docs.schema)
