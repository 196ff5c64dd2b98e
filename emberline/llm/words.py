"""Words of many texts at once as 64-bit hashes, on the UTF-8 bytes with numpy.

A word's hash is a polynomial over its bytes modulo 2**64 (odd base, random byte values), taken from prefix sums, then
mixed. Equal words have equal hashes everywhere; hashes of different words agree with a chance of about 2**-64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240115))
BYTE_VALUES = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 2**64)
WORD_BASE = 0xD6E8FEB86659FD93
WORD_BASE_INVERSE = pow(WORD_BASE, -1, 2**64)

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BLOCK_BYTES = 1 << 20  # bytes hashed at once, so that the memory beside a text is a small multiple of it
KEPT_POWERS = 1 << 21  # powers that are held for the next call; longer runs are computed anew

_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if size <= KEPT_POWERS:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix(x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x) + 1, np.uint64)
    out[0] = 0
    np.cumsum(x, out=out[1:])
    return out


def stretches(begin: np.ndarray, end: int) -> list[tuple[int, int]]:
    """Stretches that begin at the given places, the last one up to ``end``; none if nothing begins."""
    places = begin.tolist()
    return list(zip(places, [*places[1:], end], strict=True)) if places else []


@dataclass
class Words:
    """Words of a run of texts: byte places, hashes, and where each text's words begin (``n + 1`` places)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hashes of ascending, disjoint spans of bytes; ``values`` gives each byte's value. Works on about ``BLOCK_BYTES`` at once."""
    hashes = np.zeros(len(start), np.uint64)
    low = 0
    while low < len(start):
        begin = int(start[low])
        high = max(int(np.searchsorted(end, begin + BLOCK_BYTES, side="right")), low + 1)
        stop = int(end[high - 1])
        if stop - begin <= BLOCK_BYTES:
            sums = prefix(values[data[begin:stop]] * powers(BASE, stop - begin))
            at = start[low:high] - begin
            hashes[low:high] = (sums[end[low:high] - begin] - sums[at]) * powers(BASE_INVERSE, stop - begin + 1)[at]
        else:  # one long span, summed up part by part
            for cut in range(begin, stop, BLOCK_BYTES):
                part = data[cut : min(cut + BLOCK_BYTES, stop)]
                total = (values[part] * powers(BASE, len(part))).sum(dtype=np.uint64)
                hashes[low : low + 1] += total * np.array([pow(BASE, cut - begin, 2**64)], np.uint64)
        low = high
    hashes += (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    return mix(hashes)


def runs_inside(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the maximal runs of marked bytes begin and end; none crosses from one text into the next."""
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[starts] = inside[starts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[lasts] = inside[lasts]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def find_words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray, lower: bool) -> Words:
    """Words of texts that lie one behind the other in ``data``; no word crosses from one text into the next."""
    start, end = runs_inside(~(separator[LOWER] if lower else separator)[data], offsets)
    hashes = span_hashes(data, start, end, BYTE_VALUES[LOWER] if lower else BYTE_VALUES)
    return Words(start, end, hashes, np.searchsorted(start, offsets))


def windows(words: Words, size: int, base: int = WORD_BASE) -> tuple[np.ndarray, np.ndarray]:
    """Every run of ``size`` words within one text: its first word's place, and its 64-bit hash."""
    n = len(words.hash)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    last = np.repeat(words.first[1:], words.counts)
    at = np.flatnonzero(np.arange(n) + size <= last)
    inverse = pow(base, -1, 2**64)
    sums = prefix(words.hash * powers(base, n))
    return at, mix((sums[at + size] - sums[at]) * powers(inverse, n)[at])


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """Of each text its sorted distinct ``size``-word shingles; the whole sequence as one where there are fewer words."""
    at, hashes = windows(words, size)
    cuts = np.searchsorted(at, words.first)
    out = []
    for i, n in enumerate(words.counts):
        if n >= size:
            out.append(np.unique(hashes[cuts[i] : cuts[i + 1]]))
        elif n:
            short = words.hash[words.first[i] : words.first[i + 1]]
            total = np.array([int(n)], np.uint64) * np.uint64(0xE7037ED1A0B428DB)
            for h in short:
                total = mix(total ^ h)
            out.append(total)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
