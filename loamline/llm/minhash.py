"""Near-duplicate detection by b-bit MinHash, confirmed on full shingle sets.

Documents with equal shingle sets form a class; one row stands for each. Of the
``HASHES`` minima of a set the full values make band keys, and their
low ``BITS`` bits are packed into a signature. Classes that share a band key are
candidates; inside a bucket the number of equal low bits, corrected for chance
collisions, estimates the similarity, and estimates that are high enough join
classes into clusters. Inside a cluster the full sets, made again from whole
texts, decide every link; components follow from the links.

Clusters and buckets of any size are split into chunks (``components.py``), so
no group is collected as a whole and no link that joins components is lost. Bands and
the least estimate follow from the similarity asked for, so that a link of just that
similarity is missed with a probability of about ``BAND_MISS`` by the bands and
``ESTIMATE_MISS`` by the estimate: 25 bands of 5 and an estimate of 0.65 at 0.85,
32 of 4 and a lower one at 0.80.

Rows are numbered when their signatures are written, so rows are told apart whatever
their doc_ids are, and one row, the first of those with the smallest doc_id, stands
for a class or a component.

Defined cases: a document without words has an empty set, links with nothing and
is kept; rows that share a doc_id are documents of their own, and repeated rows
belong to one class; a component without any doc_id has no component_id: all of its
rows count as kept in :func:`near_duplicates`, one of them stays in :func:`representatives`;
texts may have any length; an empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loamline.llm.components import components, links_within
from loamline.llm.held import release
from loamline.llm.wordhash import grouped, hash_runs, hash_words, mix
from loamline.session import discard, materialize, ship

SHINGLE = 5
HASHES, BITS = 128, 4
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: With what probability bands and estimate may each miss a link of just that similarity.
BAND_MISS, ESTIMATE_MISS = 1e-6, 2e-8
#: Classes of a chunk of a bucket; shingles of a chunk of a cluster.
BUCKET_CHUNK, CLUSTER_CHUNK = 2048, 1 << 20
#: Candidates (32 bytes each) and rows that go (8) are broadcast up to this many and joined by a shuffle beyond.
BROADCAST_ROWS = 400_000

_U = np.uint64
_rng = np.random.default_rng(42)
_FACTORS = (_rng.integers(0, 1 << 63, HASHES, dtype=np.int64).astype(_U) * _U(2) + _U(1))[:, None]
_BAND_FACTORS = _rng.integers(0, 1 << 63, HASHES, dtype=np.int64).astype(_U) * _U(2) + _U(1)


def rows_per_band(percent: int) -> int:
    """The longest bands that miss hardly any link of this similarity."""
    found = (r for r in range(8, 1, -1) if (1 - (percent / 100) ** r) ** (HASHES // r) <= BAND_MISS)
    return next(found, 1)


def least_estimate(percent: int) -> float:
    """The largest bound on estimates that hardly any link of this similarity falls short of."""
    p, below = percent / 100 + (1 - percent / 100) * 2.0**-BITS, 0.0
    for equal in range(HASHES):
        below += math.comb(HASHES, equal) * p**equal * (1 - p) ** (HASHES - equal)
        if below > ESTIMATE_MISS:
            break
    # Half a field less, so that rounding never decides.
    return ((equal - 0.5) / HASHES - 2.0**-BITS) / (1 - 2.0**-BITS)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; the whole sequence as one where it is shorter than a shingle."""
    hashes, first, _, _ = hash_words(texts, fold=True)
    runs, out = hash_runs(hashes, SHINGLE), []
    for begin, end in zip(first[:-1].tolist(), first[1:].tolist()):
        if end - begin >= SHINGLE:
            out.append(np.unique(runs[begin : end - SHINGLE + 1]))
        else:
            out.append(hash_runs(hashes[begin:end], end - begin, salt=end - begin) if end > begin else np.zeros(0, _U))
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, ~_U(0))
    for begin in range(0, len(shingles), 2048):
        np.minimum(out, (shingles[None, begin : begin + 2048] * _FACTORS).min(1), out=out)
    return out


def band_keys(mins: np.ndarray, rows: int) -> np.ndarray:
    bands = HASHES // rows
    return mix((mins * _BAND_FACTORS)[: bands * rows].reshape(bands, rows).sum(1) + np.arange(bands, dtype=_U))


def pack(mins: np.ndarray) -> bytes:
    """The low bits of the minima, side by side."""
    low = (mins & _U((1 << BITS) - 1)).reshape(-1, 64 // BITS) << (np.arange(64 // BITS, dtype=_U) * _U(BITS))
    return np.bitwise_or.reduce(low, axis=1).astype("<u8").tobytes()


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures: the share of equal fields, less that of chance collisions."""
    differ = many ^ one
    folded = differ.copy()
    for shift in range(1, BITS):
        folded |= differ >> _U(shift)
    folded &= _U(sum(1 << i for i in range(0, 64, BITS)))
    equal = 1 - np.bitwise_count(folded).sum(1) / HASHES
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def signatures(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The columns of ``docs`` as one struct, doc_id and text, with uid (a number of the row), n_shingles, node (hash of the set), signature and bands; nulls where the set is empty."""
    rows = rows_per_band(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for begin, texts in grouped(batch.column(1).to_pylist()):
                sets = shingle_sets(texts)
                mins = [minima(s) if len(s) else None for s in sets]
                made = [
                    pa.array(np.arange(uid, uid + len(texts))),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_node(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([None if m is None else pack(m) for m in mins], pa.binary()),
                    pa.array([None if m is None else band_keys(m, rows).view(np.int64) for m in mins], pa.list_(pa.int64())),
                ]
                uid += len(texts)
                part = batch.slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names)

    ship(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*(docs[c] for c in docs.columns if c != "text")).alias("row"))
    names = [*base.columns, "uid", "n_shingles", "node", "signature", "bands"]
    schema = StructType([*base.schema.fields, *StructType.fromDDL("uid long, n_shingles long, node long, signature binary, bands array<long>").fields])
    return base.mapInArrow(run, schema)


def set_node(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _similar_signatures(percent: int):
    least = least_estimate(percent)

    def linker(block: pa.RecordBatch):
        packed = np.array([np.frombuffer(x, "<u8") for x in block.column("signature").to_pylist()])
        return lambda row, others: estimate(packed[row], packed[others]) >= least

    return linker


def _confirmed_sets(percent: int):
    def linker(block: pa.RecordBatch):
        sets: list[np.ndarray] = []
        for _, texts in grouped(block.column("text").to_pylist()):
            sets += shingle_sets(texts)
        sizes = np.array([len(s) for s in sets], np.int64)
        values, ids = np.unique(np.concatenate(sets), return_inverse=True)
        first = np.cumsum(sizes) - sizes
        mark = np.zeros(len(values), bool)

        def linked(row: int, others: np.ndarray) -> np.ndarray:
            n, m = sizes[row], sizes[others]
            hit = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (m > 0) & (n > 0)
            near = others[hit]
            if not len(near):
                return hit
            own = ids[first[row] : first[row] + n]
            mark[own] = True
            theirs = np.concatenate([ids[b : b + s] for b, s in zip(first[near].tolist(), sizes[near].tolist())])
            both = np.add.reduceat(mark[theirs].astype(np.int64), np.cumsum(sizes[near]) - sizes[near])
            mark[own] = False
            hit[hit] = 100 * both >= percent * (n + sizes[near] - both)
            return hit

        return linked

    return linker


def classified(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The written :func:`signatures` of all rows, and (node, component_id, keeper) of every class: keeper is the uid of the row that stands for its component."""
    signed = materialize(signatures(docs, percent), "signatures")
    # Rows without a doc_id come last.
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    classes = signed.filter("node is not null").groupBy("node").agg(F.min(first).alias("first"), F.max(F.struct("signature", "bands", "n_shingles")).alias("s"))
    classes = materialize(classes.select("node", "first", "s.*"), "classes")
    banded = classes.select(F.explode("bands").alias("band"), "node")
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    bucketed = banded.join(shared, "band").join(classes.select("node", "signature"), "node")
    rows = bucketed.select(F.col("band").alias("group_id"), F.col("node").alias("member"), F.lit(1).alias("weight"), "signature")
    clusters = materialize(components(links_within(rows, BUCKET_CHUNK, _similar_signatures(percent))), "clusters")
    wanted = clusters.join(classes.select("node", F.col("first.uid").alias("uid"), "n_shingles"), "node").select("root", "node", "uid", "n_shingles")
    if (n := clusters.count()) and n <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    # One row of each class brings its text.
    members = signed.select("uid", "text").join(wanted, "uid").select(F.col("root").alias("group_id"), F.col("node").alias("member"), F.col("n_shingles").alias("weight"), "text")
    roots = components(links_within(members, CLUSTER_CHUNK, _confirmed_sets(percent)))
    labels = classes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = labels.groupBy("root").agg(F.min("first").alias("least"))
    named = labels.join(least, "root").select("node", F.col("least.doc_id").alias("component_id"), F.col("least.uid").alias("keeper"))
    named = materialize(named, "components")
    discard(clusters)
    return signed, named


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    signed, named = classified(docs, percent)
    # Documents without words share no class; as nulls of a join they would meet in one task.
    alone = signed.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    linked = signed.filter("node is not null").join(named, "node").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def representatives(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their components, and those without words: one row of each group stays."""
    signed, named = classified(docs, percent)
    keepers = named.select(F.col("keeper").alias("uid")).distinct()
    gone = materialize(signed.filter("node is not null").select("uid").join(keepers, "uid", "left_anti"), "gone")
    # What goes is less than what stays; a shuffle of texts isn't needed while it fits a broadcast.
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    stay = signed.join(gone, "uid", "left_anti")
    return stay.select(*(F.col("text").cast(docs.schema["text"].dataType).alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
