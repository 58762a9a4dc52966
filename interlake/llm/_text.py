"""Numpy helpers on batches of whole texts: code points, classes, word spans, span hashes."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import xxhash

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

# The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

LONG_WORD = 64
_ODD = 0x9E3779B97F4A7C15
_U = np.uint64


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for cp in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[WHITE_SPACE] = SPACE
    return table


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end, and the n+1 offsets of the texts."""
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(sizes)])


def chunks(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about `most` characters (a longer text alone), with the index of their first."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, as far as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * _U(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * _U(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_POWERS = _Powers(0xD6E8FEB86659FD93)


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """n+1 running sums from which span_hash() makes the hash of any span."""
    up, _ = _POWERS.upto(max(1, len(values)))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + _U(1)) * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's contents; equal contents, equal hashes, wherever they stand."""
    _, down = _POWERS.upto(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def word_hashes(cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; spans of over LONG_WORD code points by xxHash, as long ones of a certain pattern have equal sums."""
    h = span_hash(prefix_hash(cps), start, end)
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(cps[start[i] : end[i]].tobytes())
    return h


def doc_starts(n: int, offsets: np.ndarray) -> np.ndarray:
    """True where a text begins."""
    out = np.zeros(n, bool)
    at = offsets[:-1]
    out[at[at < n]] = True
    return out


def word_spans(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every maximal run of letters and numbers."""
    kind = char_classes()[cps]
    word = (kind == LETTER) | (kind == NUMBER)
    fresh = doc_starts(len(cps), offsets)
    before = np.concatenate([[False], word[:-1]]) & ~fresh
    start = np.flatnonzero(word & ~before)
    after = np.concatenate([word[1:], [False]])
    after[:-1] &= ~fresh[1:]
    end = np.flatnonzero(word & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def shingle_sets(texts: list[str], words: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its shingles of lower-cased words.

    A text with fewer words has one shingle of all of them; one without words has none.
    """
    out: list[np.ndarray] = []
    for _, part in chunks([t.lower() for t in texts]):
        cps, offsets = codepoints(part)
        start, end, doc = word_spans(cps, offsets)
        h = word_hashes(cps, start, end)
        bounds = np.searchsorted(doc, np.arange(len(part) + 1))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            out.append(np.unique(_roll(h[a:b], min(words, b - a))) if b > a else np.empty(0, np.uint64))
    return out


def _roll(h: np.ndarray, k: int) -> np.ndarray:
    n = len(h) - k + 1
    acc = np.zeros(n, np.uint64)
    for i in range(k):
        acc = mix(acc * _U(_ODD) + h[i : i + n])
    return acc
