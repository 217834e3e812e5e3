"""Concatenate-and-cut packing of documents into fixed token windows.

Pass 1 tokenises every document where it lies, keeps the ids and each
document's offset inside its partition, and writes both to the shared folder.
Prefix sums over the partition totals (one number per partition) then give
every document a global offset, and pass 2 cuts the documents at the multiples
of the capacity. Neither pass shuffles a token, so no key can become hot; only
the last window of all is padded.

Defined cases: a null or empty text is the end-of-document id alone; a null
doc_id is packed like any other; repeated rows are packed once per row; texts of
any length are cut into as many pieces as they need; an empty table gives no
piece. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import string
import unicodedata
from array import array
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.held import held
from loamline.session import materialize, ship

END_ID = 2
CAPACITY = 4096
#: Partition totals are broadcast up to this many rows (16 bytes each) and joined by a shuffle beyond.
BROADCAST_ROWS = 200_000
#: Chunks of a generation that are encoded one by one. A worker remembers two (about 0.25 kB a chunk): when the
#: younger one is full, the older one goes, and chunks that are met again move on from it.
CACHE_CHUNKS = 50_000
#: Merged chunks (64 bytes at most, 9 in the mean) that a worker remembers with their ids, those that came up most and latest.
MERGED_CHUNKS = 100_000

#: How a tokenizer must normalise and split for words to be encoded one by one.
WORD_PIPELINE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

_printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
_hidden = [b for b in range(256) if b not in _printed]
#: The printable symbols that stand for bytes in byte-level vocabularies.
_BYTE_SYMBOLS = {b: chr(b) for b in _printed} | {b: chr(256 + i) for i, b in enumerate(_hidden)}

_TOKENS = "part int, doc_id long, local_start long, length long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Bytes that Merges takes: letters a-z and, behind 0xC3, those of U+00DF to U+00FF, which are lower case and NFC; ASCII punctuation.
_LATIN = np.isin(np.arange(256), [b for b in range(0x9F, 0xC0) if b != 0xB7])
_SMALL = np.isin(np.arange(256), list(string.ascii_lowercase.encode()))
_MARKS = np.isin(np.arange(256), list(string.punctuation.encode()))
_NONE = np.int32(2**31 - 1)


class Merges:
    """The merges of a byte-level BPE model, for many words at once.

    A step makes the first merge of the lowest rank in each word that has one, as
    the tokenizers library does word by word.
    """

    #: Words of similar length are merged together; symbols of a group.
    LENGTHS = (0, 1, 4, 7, 10, 14, 20, 32, 64)
    SYMBOLS = 1 << 18

    def __init__(self, model: dict) -> None:
        vocab, last = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        self.base = np.array([vocab[_BYTE_SYMBOLS[b] + end] for end in ("", last) for b in range(256)], np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        # A hash table with open addresses, a quarter full at most.
        self.shift = np.uint64(62 - len(keys).bit_length())
        self.keys = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.ranks = np.full(len(self.keys), _NONE, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]
            mine = self.keys[at] == keys[left]
            self.ranks[at[mine]] = left[mine]
            left, at = left[~mine], (at[~mine] + 1) % len(self.keys)
        self.first = self.rank(np.repeat(self.base, 512), np.tile(self.base, 512)).reshape(512, 512)

    @staticmethod
    def of(model: dict) -> Merges | None:
        """None for a model that does more than merge pairs."""
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges", "byte_fallback"))
        symbols = {s + end for s in _BYTE_SYMBOLS.values() for end in ("", model.get("end_of_word_suffix") or "")}
        return Merges(model) if plain and symbols <= model["vocab"].keys() and len(model["merges"]) == len(set(map(str, model["merges"]))) else None

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = np.where(right >= 0, left.astype(np.int64) * self.size + right, -1)
        at = self._slot(key)
        there = self.keys[at]
        found = np.where(there == key, self.ranks[at], _NONE)
        other = np.flatnonzero((there != key) & (there >= 0) & (key >= 0))
        while len(other):
            at[other] = (at[other] + 1) % len(self.keys)
            there = self.keys[at[other]]
            hit = there == key[other]
            found[other[hit]] = self.ranks[at[other[hit]]]
            other = other[~hit & (there >= 0)]
        return found

    def merge(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers of words, their ids with -1 in places that were merged away) in any order."""
        for low, n in zip(self.LENGTHS, self.LENGTHS[1:]):
            every = np.flatnonzero((lengths > low) & (lengths <= n))
            for k in range(0, len(every), self.SYMBOLS // n):
                words = every[k : k + self.SYMBOLS // n]
                yield words, self._merge(data, starts[words], lengths[words], n)

    def _merge(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
        # Symbols keep their places, which are chained; the place n of each word is the end of its chain on either side.
        place, length, width = np.arange(n), lengths[:, None], n + 1
        symbols = data[np.minimum(starts[:, None] + place, len(data) - 1)].astype(np.int32) + 256 * (place == length - 1)
        ranks = np.full((len(starts), width), _NONE)
        ranks[:, : n - 1] = np.where(place[1:] < length, self.first[symbols[:, :-1], symbols[:, 1:]], _NONE)
        whole = np.full((len(starts), width), -1, np.int32)
        whole[:, :n] = np.where(place < length, self.base[symbols], np.int32(-1))
        ids = whole.reshape(-1)
        after = np.tile(np.arange(1, width + 1, dtype=np.int8), len(starts))
        before = np.tile(np.append(np.int8(n), np.arange(n, dtype=np.int8)), len(starts))
        begin = np.arange(len(starts)) * width
        while True:
            at = ranks.argmin(axis=1)
            lowest = ranks[np.arange(len(at)), at]
            if (over := lowest == _NONE).any():
                begin, ranks, at, lowest = (x[~over] for x in (begin, ranks, at, lowest))
            if not len(at):
                return whole
            one = begin + at
            gone, left = after[one], before[one]
            right = after[begin + gone]
            ids[one] = made = self.made[lowest]
            ids[begin + gone] = -1
            after[one] = right
            before[begin + right] = at
            row, flat = np.arange(len(at)) * width, ranks.reshape(-1)
            new = self.rank(np.append(ids[begin + left], made), np.append(made, ids[begin + right]))
            flat[row + gone] = _NONE
            flat[row + left], flat[row + at] = new[: len(at)], new[len(at) :]


class ChunkEncoder(dict):
    """Maps a chunk between ASCII white space to the bytes of its ids.

    The tokenizer drops white space and never lets a token cross it, so a text's
    ids are those of its chunks in order. Punctuation behind a word is a token
    sequence of its own, and a word of letters alone goes to the merges directly
    if the tokenizer splits texts as WORD_PIPELINE says. A text with a special
    token's string, as it is or in lower case, is left to the tokenizer as a whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.code = "H" if size <= 1 << 16 else "I"
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        form = {k: part and json.loads(part.__getstate__()) for k in WORD_PIPELINE for part in [getattr(self.tokenizer, k)]}
        self.by_word = form == WORD_PIPELINE
        self.model = self.tokenizer.model
        self.merges = Merges.of(json.loads(self.tokenizer.to_str())["model"]) if self.by_word else None
        self.older: dict[str, bytes] = {}
        self[""] = b""
        self.words, self.word_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.uses = np.zeros(0, np.float32)

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if (found := self.older.get(chunk)) is not None:
            self[chunk] = found
            return found
        if not self.by_word or len(chunk) > 64:
            found = self._ids(chunk)
        elif chunk.isalpha() and chunk.islower() and (chunk.isascii() or unicodedata.is_normalized("NFC", chunk)):
            symbols = chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(_BYTE_SYMBOLS)
            found = array(self.code, [t.id for t in self.model.tokenize(symbols)]).tobytes()
        elif (word := chunk.rstrip(string.punctuation)) != chunk and unicodedata.normalize("NFC", word).lower().isalpha():
            return self[word] + self[chunk[len(word):]]
        else:
            found = self._ids(chunk)
        if len(chunk) <= 64:
            self[chunk] = found
        return found

    def _spaced(self, text: str) -> str | None:
        """The text with its chunks between single spaces; None if it is left to the tokenizer as a whole."""
        if any(s in text for s in self.specials):
            return None
        # Python lowers only the sigma by its neighbours; elsewhere both do it character by character.
        if self.by_word and "Σ" not in text and (text.isascii() or unicodedata.is_normalized("NFC", text)):
            text = text.lower()
            if any(s in text for s in self.specials):
                return None
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ")

    def _merged(self, chunks: pa.LargeStringArray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """The ids of the chunks that are small letters, then ASCII punctuation; the numbers of the others, which have none here."""
        bounds = np.frombuffer(chunks.buffers()[1], np.int64, len(chunks) + 1, chunks.offset * 8)
        data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)
        if self.merges is None or not len(data):
            return pa.array([b""] * len(chunks), pa.large_binary()), np.arange(len(chunks))
        behind, ahead = np.append(np.uint8(0), data[:-1]), np.append(data[1:], np.uint8(0))
        letter = _SMALL[data] | (data == 0xC3) & _LATIN[ahead] | _LATIN[data] & (behind == 0xC3)
        mark = _MARKS[data]
        back = letter & np.append(False, mark[:-1])
        back[bounds[:-1][bounds[:-1] < len(data)]] = False

        def count(which: np.ndarray) -> np.ndarray:
            return np.diff(np.append(0, np.cumsum(which))[bounds])

        sizes, letters = np.diff(bounds), count(letter)
        taken = (sizes <= Merges.LENGTHS[-1]) & (count(~(letter | mark) | back) == 0)
        starts = np.stack([bounds[:-1], bounds[:-1] + letters], 1).ravel()
        lengths = np.where(taken[:, None], np.stack([letters, sizes - letters], 1), 0).ravel()
        groups = []
        n = np.zeros(len(lengths), np.int64)
        for words, ids in self.merges.merge(data, starts, lengths):
            real = ids >= 0
            n[words] = real.sum(axis=1)
            groups.append((words, ids[real].astype(self.dtype)))
        at = np.append(0, np.cumsum(n))
        out = np.empty(at[-1], self.dtype)
        for words, ids in groups:
            k = n[words]
            out[np.repeat(at[words] - np.cumsum(k) + k, k) + np.arange(len(ids))] = ids
        ends = at[::2] * self.dtype.itemsize
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(chunks), [None, pa.py_buffer(ends), pa.py_buffer(out)]), np.flatnonzero(~taken)

    def _coded(self, chunks: pa.LargeStringArray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """Ids, and the place in them of each of the distinct chunks. Merged chunks are remembered for later batches."""
        at = pc.index_in(chunks, value_set=self.words)
        place, new = at.fill_null(0).to_numpy().astype(np.int64), np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        fresh = chunks.take(pa.array(new))
        merged, rest = self._merged(fresh)
        found = pa.array([self[c] for c in fresh.take(pa.array(rest)).to_pylist()], pa.large_binary())
        uses = np.append(self.uses * np.float32(0.9), np.ones(len(new), np.float32))
        uses[np.delete(place, new)] += 1
        uses[len(self.words) + rest] = -1
        place[new] = len(self.words) + np.arange(len(new))
        place[new[rest]] = len(uses) + np.arange(len(rest))
        words, ids = pa.concat_arrays([self.words, fresh]), pa.concat_arrays([self.word_ids, merged])
        kept = np.argsort(-uses, kind="stable")[: min(MERGED_CHUNKS, np.count_nonzero(uses >= 0))]
        self.words, self.word_ids, self.uses = words.take(pa.array(kept)), ids.take(pa.array(kept)), uses[kept]
        return pa.concat_arrays([ids, found]), place

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0].as_py()

    def encode_all(self, texts: Sequence[str | None], end: bytes = b"") -> pa.BinaryArray:
        """The ids of each text (null: none) and ``end`` behind them. Each distinct chunk is looked up once."""
        if len(self) > CACHE_CHUNKS:
            self.older = dict(self)
            self.clear()
            self[""] = b""
        spaced = [self._spaced(t) if t else "" for t in texts]
        split = pc.split_pattern(pa.array(spaced, pa.large_string()).fill_null(""), " ")
        bounds = split.offsets.to_numpy()
        coded = split.values.dictionary_encode()
        known, place = self._coded(coded.dictionary)
        found: list[bytes] = []
        which = place[coded.indices.to_numpy()]
        for i, (t, s) in enumerate(zip(texts, spaced)):
            if s is None:
                which[bounds[i]] = len(known) + len(found)
                found.append(self._ids(t))
        if end:
            which = np.insert(which, bounds[1:], len(known) + len(found))
            found.append(end)
            bounds = bounds + np.arange(len(bounds))
        ids = pa.concat_arrays([known, pa.array(found, pa.large_binary())]).take(pa.array(which))
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[bounds]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends), ids.buffers()[2]]).cast(pa.binary())


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a tokenizer file; it outlives tasks, so its cache does too."""
    return held("packing", path, lambda: ChunkEncoder(path))


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Ids of every document with the end id, and its offset inside its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        end, width, part, at = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize, TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = enc.encode_all(batch.column(1).to_pylist(), end)
            lengths = pc.binary_length(ids).to_numpy().astype(np.int64) // width
            ends = at + np.cumsum(lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int32)), batch.column(0), pa.array(ends - lengths), pa.array(lengths), ids],
                ["part", "doc_id", "local_start", "length", "ids"],
            )
            at = int(ends[-1]) if len(ends) else at

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _TOKENS)


def cut(tokens: DataFrame, width: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of documents whose global offset ``first`` is known; a piece never crosses a multiple of ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            # The pieces of a batch follow one another without a gap, as its ids do.
            ids = np.frombuffer(b"".join(batch.column(2).to_pylist()), f"<u{width}").astype("<i4")
            begin = 0
            for doc, first, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (pc.binary_length(batch.column(2)).to_numpy() // width).tolist()):
                at = 0
                while at < n:
                    sequence, offset = divmod(first + at, capacity)
                    take = min(capacity - offset, n - at)
                    for column, value in zip(out, (doc, at, take, zlib.crc32(ids[begin + at : begin + at + take]), n, sequence, offset)):
                        column.append(value)
                    at += take
                begin += n
            arrays = [pa.array(x, pa.int64()) for x in out]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(np.cumsum([0, *out[2]], dtype=np.int32), pa.array(ids, pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = _PIECES + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return tokens.select("doc_id", "first", "ids").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: where it starts in its document, its window (sequence_id), its place there, and its ids."""
    tokens = materialize(tokenize(docs, tokenizer_path, end_id), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("length").alias("total"))
    # One row per partition of the scan, so a single ordered window is small at any input size.
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    if totals.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    placed = tokens.join(bases, "part").withColumn("first", F.col("base") + F.col("local_start"))
    return cut(placed, encoder(tokenizer_path).dtype.itemsize, capacity, with_ids)


def windows(pieces: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """Whole windows from :func:`pack` pieces with ids: at most ``capacity`` pieces meet in a group.

    A window is padded to the capacity unless its own length is a power of two.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    joined = F.flatten(F.transform("parts", lambda p: p["ids"]))
    size = F.size("ids")
    whole = (size.bitwiseAND(size - 1) == 0) & (size > 0)
    return (
        pieces.groupBy("sequence_id").agg(parts.alias("parts"))
        .select("sequence_id", joined.alias("ids"), F.transform("parts", lambda p: p["offset"]).alias("boundaries"), F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"))
        .withColumn("n_tokens", size)
        .withColumn("ids", F.when(whole, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), F.greatest(F.lit(0), F.lit(capacity) - size)))))
    )
