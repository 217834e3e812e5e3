"""Removal of repeated passages by seed and extend.

Every window of WINDOW words is seeded by one of its own ANCHOR-word runs, the
one with the smallest hash (winnowing), so equal windows have equal seeds. A
record is a seed in a document with the stretch of consecutive windows that it
seeds. Documents meet on seeds:

1. Records with the same seed and the same whole stretch match as far as both
   reach; all but the earliest are repeats.
2. Only where one seed has several different stretches can a match end inside
   one. There the earliest record of each stretch is extended window by window
   from the text, and a window that starts earlier elsewhere is a repeat.

The earliest start of any window lies in the earliest record of its stretch, so
step 2 loses nothing. Repeats are joined per document to maximal covered ranges
of words, which are cut out. Keys are 128 bits of hashes (seed and stretch or
window). Records of a hot passage are reduced to the earliest of each 300,000
before they are shuffled; ranks stream through sorted rows and spill.

A document is told by doc and twin: twin is a hash of the text where a doc_id stands
several times, or where there is none, and 0 for all others, so it takes no room in
what is shuffled. Texts that differ don't share ranges.

Defined cases: a null text has no words; texts shorter than a window are kept
whole; texts may have any length; rows of one doc_id with the same text are one
document, and don't repeat each other; those with different texts are documents
of their own, ordered by a hash of the text, and so are rows without a doc_id, which
come before all others; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.held import release
from loamline.llm.wordhash import grouped, hash_runs, hash_words, mix, pieces, powers
from loamline.session import materialize, ship

WINDOW, ANCHOR = 20, 6
#: Windows of a long text that are looked at together.
SEGMENT = 1 << 18
#: Records (40 bytes each) within which copies are reduced before they are shuffled.
HELD_RECORDS = 300_000
_NULL_ID = -(1 << 63)
_U = np.uint64
_STRETCH = 0xA0761D6478BD642F
#: doc_ids that stand several times (8 bytes each) are broadcast up to this many and joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000


def seeds(hashes: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """For each window of the words, where its seed begins (the leftmost smallest anchor)."""
    runs = hash_runs(hashes, anchor, salt=1)
    width = window - anchor + 1
    views = np.lib.stride_tricks.sliding_window_view(runs, width)
    out = np.empty(len(views), np.int64)
    for begin in range(0, len(views), 1 << 16):
        out[begin : begin + (1 << 16)] = views[begin : begin + (1 << 16)].argmin(1)
    return out + np.arange(len(views))


def records(texts: list[bytes], window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, seed hash, stretch hash) of all records of the texts."""
    hashes, first = hash_words(texts, fold=False)[:2]
    if len(texts) > 1 or len(hashes) < SEGMENT + window:
        return _records(hashes, first, window, anchor)
    # A stretch that ends at a segment's end is one more stretch of its seed.
    parts = []
    for begin in range(0, len(hashes) - window + 1, SEGMENT):
        part = hashes[begin : begin + SEGMENT + window - 1]
        owner, start, *rest = _records(part, np.array([0, len(part)]), window, anchor)
        parts.append((owner, start + begin, *rest))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _records(hashes: np.ndarray, first: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    if len(hashes) < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U, _U))
    seed, runs = seeds(hashes, window, anchor), hash_runs(hashes, anchor, salt=1)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(owner[: len(seed)] == owner[window - 1 :])
    if not len(at):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U, _U))
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(seed[at]) != 0) | (np.diff(owner[at]) != 0)) + 1
    begins = at[np.concatenate([[0], cut])]
    counts = np.diff(np.concatenate([[0], cut, [len(at)]]))
    power, inverse = powers(_STRETCH, len(hashes))
    sums = np.zeros(len(hashes) + 1, _U)
    np.cumsum(hashes * power, out=sums[1:])
    where = seed[begins]
    stretch = mix((sums[begins + counts + window - 1] - sums[begins]) * inverse[begins] + (counts * 64 + where - begins).astype(_U))
    return owner[begins], begins - first[owner[begins]], counts, runs[where], stretch


def window_hashes(raw: bytes, window: int) -> np.ndarray:
    return hash_runs(hash_words([raw], fold=False)[0], window, salt=2)


def _records_of(window: int, anchor: int):
    def reduced(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        """Of every stretch the earliest record goes on; later ones are known to be repeats."""
        doc, twin, start, count, seed, stretch = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((start, twin, doc, stretch, seed))
        doc, twin, start, count, seed, stretch = (x[order] for x in (doc, twin, start, count, seed, stretch))
        new = np.concatenate([[True], (seed[1:] != seed[:-1]) | (stretch[1:] != stretch[:-1])])
        group = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (doc != doc[group]) | (twin != twin[group]) | (start != start[group])
        keep = new | later
        # Known repeats need no meeting; their own place serves as key and spreads them.
        key = np.where(later, mix(doc.astype(_U) * _U(31) + start.astype(_U)), seed)
        columns = [key.view(np.int64), stretch.view(np.int64), doc, twin, start.astype(np.int32), count.astype(np.int32), later]
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], ["seed", "stretch", "doc", "twin", "start", "windows", "later"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        parts, held = [], 0
        for batch in batches:
            ids, twins = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for begin, texts in grouped(batch.column(2).to_pylist()):
                owner, start, count, seed, stretch = records(texts, window, anchor)
                if len(owner):
                    parts.append((ids[begin + owner], twins[begin + owner], start, count, seed, stretch))
                    held += len(owner)
            if held >= HELD_RECORDS:
                yield reduced(parts)
                parts, held = [], 0
        if held:
            yield reduced(parts)

    return run


def _windows_of(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Equal rows of one document say the same; of those that follow closely one is enough.
        met: set[tuple[int, int]] = set()
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
                for doc, twin, text, places in zip(*(part.column(i).to_pylist() for i in range(4))):
                    if twin:
                        if (doc, twin) in met:
                            continue
                        if len(met) > 10_000:
                            met.clear()
                        met.add((doc, twin))
                    found = window_hashes((text or "").encode(), window).view(np.int64)
                    for place in places:
                        here = np.arange(place["start"], min(place["start"] + place["windows"], len(found)))
                        for column, values in zip(out, (np.full(len(here), place["seed"]), found[here], np.full(len(here), doc), np.full(len(here), twin), here)):
                            column.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["seed", "win", "doc", "twin", "start"])

    return run


def kept_words(raw: bytes, spans: list[tuple[int, int]] | None, window: int) -> tuple[int, np.ndarray | None]:
    """How many words a text has, and which of them stay (None: all)."""
    n = sum(len(piece.split()) for piece in pieces(raw))
    if not spans:
        return n, None
    edge = np.zeros(n + 1, np.int32)
    for start, windows in spans:
        edge[min(start, n)] += 1
        edge[min(start + windows + window - 1, n)] -= 1
    return n, np.cumsum(edge[:-1]) == 0


def kept_digest(raw: bytes, keep: np.ndarray | None) -> str:
    """SHA-256 of the words that stay, joined by one space."""
    found, at, between = hashlib.sha256(), 0, b""
    for piece in pieces(raw):
        words = piece.split()
        at += len(words)
        left = words if keep is None else list(compress(words, keep[at - len(words) : at].tolist()))
        if left:
            found.update(between + b" ".join(left))
            between = b" "
    return found.hexdigest()


def without(raw: bytes, keep: np.ndarray) -> str:
    """The text without the other words; words that stay side by side keep what lies between them."""
    _, _, starts, ends = hash_words([raw], fold=False)
    edge = np.flatnonzero(np.diff(keep, prepend=False, append=False))
    return b" ".join(raw[starts[a] : ends[b - 1]] for a, b in zip(edge[0::2], edge[1::2])).decode()


def _cut(window: int, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                rows = []
                for doc, twin, text, spans in zip(*(part.column(i).to_pylist() for i in range(4))):
                    raw = (text or "").encode()
                    n_words, keep = kept_words(raw, [(s["start"], s["windows"]) for s in spans or []], window)
                    if digests:
                        result = kept_digest(raw, keep)
                    else:
                        result = text if keep is None else without(raw, keep)
                    rows.append((doc, twin, n_words, 0 if keep is None else int((~keep).sum()), result))
                columns = list(zip(*rows))
                kinds = [pa.int64()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc", "twin", "n_words", "n_removed", "result"])

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with doc and twin, which tell documents apart, behind its columns."""
    hashed = F.xxhash64(F.col("text").cast("string"))
    # Negative without a doc_id, so that these come first even where a doc_id is the least of all.
    nameless, several = hashed.bitwiseOR(F.lit(_NULL_ID)), hashed.bitwiseAND(F.lit(~_NULL_ID))
    doc_id = F.col("doc_id").cast("long")
    known = docs.select(doc_id.alias("clashing doc")).filter(F.col("clashing doc").isNotNull())
    clashing = materialize(known.groupBy("clashing doc").agg(F.count("*").alias("n")).filter("n > 1").select("clashing doc"), "clashing")
    n = clashing.count()
    doc, none = F.coalesce(doc_id, F.lit(_NULL_ID)), F.col("doc_id").isNull()
    if not n:
        return docs.withColumns({"substring doc": doc, "substring twin": F.when(none, nameless).otherwise(F.lit(0).cast("long"))})
    if n <= BROADCAST_ROWS:
        clashing = F.broadcast(clashing)
    met = docs.withColumn("substring doc", doc).join(clashing, F.col("substring doc") == F.col("clashing doc"), "left")
    return met.withColumn("substring twin", F.when(none, nameless).when(F.col("clashing doc").isNotNull(), several).otherwise(F.lit(0).cast("long"))).drop("clashing doc")


def repeated(texts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc, twin, spans) of documents with repeats; a span is its first window and their number. ``texts``: doc, twin, text."""
    found = texts.mapInArrow(_records_of(window, anchor), "seed long, stretch long, doc long, twin long, start int, windows int, later boolean")
    met = found.repartition("seed")
    same = Window.partitionBy("seed", "stretch")
    seeded = Window.partitionBy("seed")
    ranked = met.withColumn("rank", F.rank().over(same.orderBy("doc", "twin", "start"))).withColumn("several", F.min("stretch").over(seeded) != F.max("stretch").over(seeded))
    hits = materialize(
        ranked.withColumn("repeat", F.col("later") | (F.col("rank") > 1)).filter(F.col("repeat") | F.col("several")).select("seed", "doc", "twin", "start", "windows", "repeat"),
        "hits",
    )
    partial = hits.filter(~F.col("repeat")).groupBy("doc", "twin").agg(F.collect_set(F.struct("seed", "start", "windows")).alias("places"))
    # The same exchange of texts as that of the last join.
    placed = texts.join(partial, ["doc", "twin"]).select("doc", "twin", "text", "places")
    extended = placed.mapInArrow(_windows_of(window), "seed long, win long, doc long, twin long, start long")
    first = F.rank().over(Window.partitionBy("seed", "win").orderBy("doc", "twin", "start"))
    single = extended.withColumn("rank", first).filter("rank > 1").select("doc", "twin", F.col("start").cast("int"), F.lit(1).alias("windows"))
    spans = hits.filter("repeat").select("doc", "twin", "start", "windows").unionByName(single)
    return spans.groupBy("doc", "twin").agg(F.collect_set(F.struct("start", "windows")).alias("spans"))


def deduplicate(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, digests: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the text that stays (or, with ``digests``, the SHA-256 of its words joined by one space)."""
    ship(docs.sparkSession)
    texts = keyed(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    texts = texts.select(F.col("substring doc").alias("doc"), F.col("substring twin").alias("twin"), "text")
    spans = repeated(texts, window, anchor)
    joined = texts.join(spans, ["doc", "twin"], "left").select("doc", "twin", "text", "spans")
    cut = joined.mapInArrow(_cut(window, digests), "doc long, twin long, n_words long, n_removed long, result string")
    # Only rows without a doc_id have a negative twin.
    doc_id = F.when(F.col("twin") >= 0, F.col("doc")).alias("doc_id")
    return cut.select(doc_id, "n_words", "n_removed", F.col("result").alias("kept_sha256" if digests else "text"))


def cleaned(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The rows of ``docs``, with all their columns, their texts without repeats."""
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(batch.column(len(names)).to_pylist()):
                if spans:
                    raw = (texts[i] or "").encode()
                    texts[i] = without(raw, kept_words(raw, [(s["start"], s["windows"]) for s in spans], window)[1])
            columns = batch.columns[: len(names)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    ship(docs.sparkSession)
    marked = keyed(docs)
    texts = marked.select(F.col("substring doc").alias("doc"), F.col("substring twin").alias("twin"), F.col("text").cast("string"))
    spans = repeated(texts, window, anchor).select(F.col("doc").alias("span doc"), F.col("twin").alias("span twin"), F.col("spans").alias("substring spans"))
    same = (F.col("substring doc") == F.col("span doc")) & (F.col("substring twin") == F.col("span twin"))
    return marked.join(spans, same, "left").select(*names, "substring spans").mapInArrow(run, docs.schema)
