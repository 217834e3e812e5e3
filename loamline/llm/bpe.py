"""Byte-level BPE by monoid tree reduction.

A pre-token is halved recursively. The halves' encodings are joined by
re-encoding a window of tokens around the seam and growing it until both tokens
just outside it are compatible with the window's outer tokens. A sequence of
reachable tokens is the encoding of its bytes exactly if every neighbouring pair
is (the pair's bytes encode to that pair), so a compatible seam proves that
everything outside the window is stable. Decoding concatenates up the tree.

Pre-tokens are encoded separately and remembered by a worker, so a document is a
concatenation of remembered results. The map is row by row: no shuffle, no key.

Defined cases: a null or empty text has no ids; texts and pre-tokens may have
any length; repeated rows give repeated results; an empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.held import held
from loamline.session import ship

LEAF_BYTES, LEAF_TOKENS = 24, 256
CACHE_PIECES = 500_000
#: Unicode White_Space, written out: Python's own \s also takes the ASCII separators 1C to 1F.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def explicit_space(pattern: str) -> str:
    """``pattern`` with \\s and \\S spelled out."""
    out = pattern.replace(r"[^\s", f"[^{_SPACE}")
    return out.replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")


class TreeBPE:
    """Ranks of a byte-level vocabulary with encode, join and decode."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self._compatible: dict[tuple[int, int], bool] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Lowest-rank-first merging, leftmost among equals."""
        if len(piece) > 64:
            return self._merge_heap(piece)
        ranks, parts = self.ranks, [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best = min((r for r in pairs if r is not None), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i])
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1])

    def _merge_heap(self, piece: bytes) -> list[int]:
        """The same in n log n: a heap of (rank, start) over a linked list of parts."""
        ranks, n = self.ranks, len(piece)
        ends, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = ends[i]
            if middle is None or middle >= n or ends[middle] != end:
                continue
            ends[i], ends[middle] = end, None
            if end < n:
                before[end] = i
                if (r := ranks.get(piece[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if i and (r := ranks.get(piece[before[i] : end])) is not None:
                heapq.heappush(heap, (r, before[i], end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes encode to just these two tokens."""
        key = (left, right)
        if (known := self._compatible.get(key)) is None:
            if len(self._compatible) > CACHE_PIECES:
                self._compatible.clear()
            known = self._compatible[key] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the concatenated bytes from the encodings of both sides."""
        if not left or not right:
            return left or right
        if self.compatible(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merge(b"".join(map(self.tokens.__getitem__, left[len(left) - i :] + right[:j])))
            low = i == len(left) or self.compatible(left[-i - 1], window[0])
            high = j == len(right) or self.compatible(window[-1], right[j])
            if low and high:
                return left[: len(left) - i] + window + right[j:]
            i, j = i if low else 2 * i, j if high else 2 * j

    def tree(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF_BYTES:
            return self.merge(piece)
        middle = len(piece) // 2
        return self.join(self.tree(piece[:middle]), self.tree(piece[middle:]))

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token; one that is itself in the vocabulary is that token."""
        if not piece:
            return []
        return [self.ranks[piece]] if piece in self.ranks else self.tree(piece)

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids."""
        return concatenated(ids, self.tokens)


def concatenated(ids: list, tokens: dict) -> bytes:
    """Up the tree: leaves are looked up, inner nodes concatenate."""
    if len(ids) <= LEAF_TOKENS:
        return b"".join(map(tokens.__getitem__, ids))
    middle = len(ids) // 2
    return concatenated(ids[:middle], tokens) + concatenated(ids[middle:], tokens)


class PieceEncoder(dict):
    """Maps a pre-token to its ids, written in decimal and joined by commas."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import regex

        self.bpe = TreeBPE(ranks_path)
        self.split = regex.compile(explicit_space(pattern)).findall
        self.written = {str(i).encode(): t for i, t in self.bpe.tokens.items()}

    def __missing__(self, piece: str) -> bytes:
        found = b",".join(b"%d" % i for i in self.bpe.encode_piece(piece.encode()))
        if len(piece) <= 64:
            self[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        if len(self) > CACHE_PIECES:
            self.clear()
        return b",".join(map(self.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return concatenated(ids.split(b","), self.written) if ids else b""


def encoder(ranks_path: str, pattern: str) -> PieceEncoder:
    return held("bpe", f"{ranks_path} {pattern}", lambda: PieceEncoder(ranks_path, pattern))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, digests: bool = False) -> DataFrame:
    """Ids and decoded text of every document; with ``digests``, their SHA-256 instead.

    Columns: doc_id, n_tokens, then ids (array) and decoded (binary), or
    ids_sha256 (of the decimal ids joined by commas) and decoded_sha256.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                counts, first, second = [], [], []
                for text in part.column(1).to_pylist():
                    ids = enc.encode(text) if text else b""
                    decoded = enc.decode(ids)
                    counts.append(ids.count(b",") + 1 if ids else 0)
                    if digests:
                        first.append(hashlib.sha256(ids).hexdigest())
                        second.append(hashlib.sha256(decoded).hexdigest())
                    else:
                        first.append([int(x) for x in ids.split(b",")] if ids else [])
                        second.append(decoded)
                kinds = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(first, kinds[0]), pa.array(second, kinds[1])], names)

    ship(docs.sparkSession)
    names = ["doc_id", "n_tokens"] + (["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
