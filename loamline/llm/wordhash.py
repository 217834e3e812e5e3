"""64-bit hashes of words and of runs of words, for many texts at once.

Words are the runs of bytes other than space and 09 to 0D. All hashes are
polynomials modulo 2**64 over random tables, taken from prefix sums (their base
is odd and so has an inverse) and finished by a mixing step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np

_U = np.uint64
_rng = np.random.default_rng(20240607)
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_TABLE[SPACE] = 0
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]
_BASE, _WORDS = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Bytes of text that are hashed at once; a longer text is hashed alone, piece by piece.
GROUP_BYTES = 1 << 19
_WHITE = re.compile(rb"[ \t-\r]")
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, GROUP_BYTES + 4096)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, _U)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        have = made[0], made[1]
        if size <= 1 << 25:
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def hash_words(texts: list[bytes], fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of the texts; where each text's words begin (one more entry than texts); byte ranges of the words in the joined texts."""
    joined = b" ".join(texts) + b" "
    place = np.int32 if len(joined) < 1 << 31 else np.int64
    hashes, starts, ends, at = [], [], [], 0
    for piece in pieces(joined):
        data = np.frombuffer(piece, np.uint8)
        edge = np.flatnonzero(np.diff(~SPACE[data], prepend=False, append=False))
        power, inverse = powers(_BASE, len(data))
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum((_FOLDED if fold else _TABLE)[data] * power, out=sums[1:])
        begin, end = edge[0::2], edge[1::2]
        hashes.append(mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(_U)))
        starts.append((begin + at).astype(place))
        ends.append((end + at).astype(place))
        at += len(piece)
    hashes, starts, ends = (np.concatenate(x) for x in (hashes, starts, ends))
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
    return hashes, first, starts, ends


def pieces(raw: bytes) -> Iterator[bytes]:
    """The bytes in pieces of about GROUP_BYTES that end at white space."""
    at = 0
    while at < len(raw):
        space = _WHITE.search(raw, at + GROUP_BYTES) if len(raw) - at > 2 * GROUP_BYTES else None
        end = space.end() if space else len(raw)
        yield raw[at:end]
        at = end


def hash_runs(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of k consecutive words; entry i begins at word i."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, _U)
    out = np.empty(n - k + 1, _U)
    for begin in range(0, len(out), GROUP_BYTES):
        part = hashes[begin : begin + GROUP_BYTES + k - 1]
        m = len(part) - k + 1
        power, inverse = powers(_WORDS, len(part))
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(part * power, out=sums[1:])
        out[begin : begin + m] = mix((sums[k:] - sums[:m]) * inverse[:m] + _U(salt))
    return out


def grouped(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, UTF-8 texts) of groups of about GROUP_BYTES."""
    begin, held, group = 0, 0, []
    for i, text in enumerate(texts):
        raw = text.encode() if text else b""
        if group and held + len(raw) > GROUP_BYTES:
            yield begin, group
            begin, held, group = i, 0, []
        held += len(raw)
        group.append(raw)
    if group:
        yield begin, group


@cache
def _letters() -> np.ndarray:
    """A random hash for each code point that is a letter; 0 for others."""
    every = "".join(" " if 0xD800 <= c < 0xE000 else chr(c) for c in range(0x110000))
    found = np.zeros(len(every), _U)
    for run in re.finditer(r"[^\W\d_]+", every):
        found[run.start() : run.end()] = mix(np.arange(run.start() + 1, run.end() + 1, dtype=_U) * _U(_BASE)) | _U(1)
    return found


def hash_letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of letters of lower-cased texts, and which text each is from."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer((" ".join(lowered) + " ").encode("utf-32-le"), "<u4")
    values = _letters()[codes]
    edge = np.flatnonzero(np.diff(values != 0, prepend=False))
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = powers(_BASE, len(codes))
    sums = np.zeros(len(codes) + 1, _U)
    np.cumsum(values * power, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U))
    return hashes, np.searchsorted(np.cumsum([len(t) + 1 for t in lowered]), starts, side="right")


class HashTable:
    """Numbers of distinct 64-bit hashes, by open addressing."""

    def __init__(self, hashes: np.ndarray) -> None:
        size = 1 << max(4, int(2 * len(hashes)).bit_length())
        self.mask = _U(size - 1)
        self.keys, self.numbers = np.zeros(size, _U), np.full(size, -1, np.int32)
        left = np.arange(len(hashes), dtype=np.int32)
        at = (hashes & self.mask).astype(np.int64)
        while len(left):
            free = self.numbers[at] < 0
            self.numbers[at[free]] = left[free]
            here = self.numbers[at] == left
            self.keys[at[here]] = hashes[left[here]]
            left, at = left[~here], (at[~here] + 1) & (size - 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for unknown ones."""
        at = (hashes & self.mask).astype(np.int64)
        found = self.numbers[at]
        left = np.flatnonzero((found >= 0) & (self.keys[at] != hashes))
        while len(left):
            at[left] = (at[left] + 1) & int(self.mask)
            found[left] = self.numbers[at[left]]
            left = left[(found[left] >= 0) & (self.keys[at[left]] != hashes[left])]
        return found
