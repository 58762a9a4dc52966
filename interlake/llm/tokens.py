"""Whole-text byte-level BPE ids, by the tokenizers library with a word cache.

The byte-level pre-tokeniser is applied to whole batches in numpy; each distinct word is encoded
once by the library's own model and remembered, so a batch costs one table look-up a word.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from interlake.llm._text import LETTER, SPACE, char_classes, chunks, codepoints, doc_starts, word_hashes


def word_starts(cps: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True where a word of the byte-level pre-tokeniser's pattern starts.

    Fixed pattern: 's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|spaces not before a non-space|spaces
    """
    n = len(cps)
    kind = char_classes()[cps]
    fresh = doc_starts(n, offsets)
    last = np.zeros(n, bool)
    last[:-1] = fresh[1:]
    if n:
        last[-1] = True
    before = np.empty(n, np.uint8)
    before[:1], before[1:] = 255, kind[:-1]
    before[fresh] = 255
    starts = kind != before
    # The last of several spaces stands apart if something follows; a plain blank joins what follows.
    space = kind == SPACE
    follows = np.empty(n, np.uint8)
    follows[:-1], follows[-1:] = kind[1:], 255
    follows[last] = 255
    final = space & (follows != SPACE) & (follows != 255)
    starts |= final
    joined = np.flatnonzero(final & (cps == 0x20)) + 1
    starts[joined] = False
    # Contractions: an apostrophe that is a word by itself so far, then a fixed ending.
    quote = np.flatnonzero((cps == 0x27) & starts & (follows == LETTER))
    if len(quote):
        ahead = np.pad(cps, (0, 3))
        near = np.pad(fresh, (0, 3), constant_values=True)
        one, two = ahead[quote + 1], np.where(near[quote + 2], 0, ahead[quote + 2])
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            double |= (one == ord(a)) & (two == ord(b))
        hit = single | double
        at, size = quote[hit], np.where(single, 2, 3)[hit]
        starts[at + 1] = False
        after = at + size
        inside = after < n
        starts[after[inside]] = True
    return starts


class WordCache:
    """Ids of words by the words' 64-bit hashes: an open-addressing table in numpy. A hit counts only if the word itself is the same."""

    def __init__(self, path: str, most: int = 1 << 18):
        self.model = Tokenizer.from_file(path).model
        self.most = most
        self.bytes_to_chars = _byte_alphabet()
        self.reset()

    def reset(self) -> None:
        self.bits = 20
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.slot = np.zeros(1 << self.bits, np.int32)
        self.n = 0
        self.begin = np.zeros(self.most + 1, np.int64)
        self.pool = np.zeros(1 << 20, np.uint32)
        self.text_begin = np.zeros(self.most + 1, np.int64)
        self.text = np.zeros(1 << 20, np.uint32)

    def ids(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.bytes_to_chars))]

    def holds(self, slot: np.ndarray, cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """True where the word in the slot is the span's own."""
        size = end - start
        out = self.text_begin[slot + 1] - self.text_begin[slot] == size
        upto = np.cumsum(size)
        at = np.arange(int(upto[-1]) if len(upto) else 0)
        there = np.repeat(self.text_begin[slot] - (upto - size), size) + at
        other = self.text[np.minimum(there, len(self.text) - 1)] != cps[np.repeat(start - (upto - size), size) + at]
        if other.any():
            out[np.searchsorted(upto, np.flatnonzero(other), "right")] = False
        return out

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 where it is new."""
        mask = np.uint64((1 << self.bits) - 1)
        at = (h & mask).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        got = self.keys[at]
        hit = got == h
        out[hit] = self.slot[at[hit]]
        rest = np.flatnonzero(~hit & (got != 0))
        step = 1
        while len(rest):
            at_rest = (at[rest] + step) & int(mask)
            got = self.keys[at_rest]
            hit = got == h[rest]
            out[rest[hit]] = self.slot[at_rest[hit]]
            rest = rest[~hit & (got != 0)]
            step += 1
        return out

    def _put(self, pool: np.ndarray, begin: np.ndarray, flat: np.ndarray, sizes: list[int]) -> np.ndarray:
        """The pool with `flat` behind what it holds, and where each of its parts begins."""
        used = int(begin[self.n])
        while used + len(flat) > len(pool):
            pool = np.concatenate([pool, np.zeros_like(pool)])
        pool[used : used + len(flat)] = flat
        begin[self.n + 1 : self.n + 1 + len(sizes)] = used + np.cumsum(sizes)
        return pool

    def add(self, h: np.ndarray, words: list[str]) -> None:
        if self.n + len(words) > self.most:
            self.reset()
            if len(words) > self.most:
                raise ValueError("more distinct words in a batch than the cache holds")
        mask = (1 << self.bits) - 1
        found = [self.ids(w) for w in words]
        self.pool = self._put(self.pool, self.begin, np.array([i for ids in found for i in ids], np.uint32), [len(x) for x in found])
        self.text = self._put(self.text, self.text_begin, codepoints(words)[0], [len(w) for w in words])
        new = np.arange(self.n, self.n + len(words), dtype=np.int32)
        self.n += len(words)
        at, todo, step = (h & np.uint64(mask)).astype(np.int64), np.arange(len(h)), 0
        while len(todo):  # of those that want one free place, the last written gets it
            place = (at[todo] + step) & mask
            free = self.keys[place] == 0
            self.keys[place[free]] = h[todo[free]]
            won = self.keys[place] == h[todo]
            self.slot[place[won]] = new[todo[won]]
            todo = todo[~won]
            step += 1


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary, by its published rule."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@lru_cache(2)
def word_cache(path: str) -> WordCache:
    """One cache a vocabulary and process."""
    return WordCache(path)


@lru_cache(2)
def added_tokens(path: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """Pattern and ids of the vocabulary's added tokens; of several at one place the longest counts."""
    found = Tokenizer.from_file(path).get_added_tokens_decoder()
    if any(t.lstrip or t.rstrip or t.single_word for t in found.values()):
        raise ValueError("added tokens that take blanks in or stand as single words only aren't supported")
    ids = {t.content: i for i, t in found.items()}
    return (re.compile("(" + "|".join(re.escape(c) for c in sorted(ids, key=len, reverse=True)) + ")") if ids else None), ids


def encode(texts: list[str], path: str, *, added: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and the n+1 offsets of the texts.

    With added=True the vocabulary's added tokens in a text get their own ids, as by the library's defaults; else their strings are ordinary text.
    """
    if added:
        pattern, known = added_tokens(path)
        if pattern and any(c in t for t in texts for c in known):
            return _encode_split([pattern.split(t) for t in texts], path, known)
    cache = word_cache(path)
    parts, sizes = [], []
    for _, part in chunks(texts):
        cps, offsets = codepoints(part)
        if not len(cps):
            sizes.append(np.zeros(len(part), np.int64))
            continue
        start = np.flatnonzero(word_starts(cps, offsets))
        end = np.append(start[1:], len(cps))
        h = word_hashes(cps, start, end)
        h[h == 0] = 1
        joined, size = None, np.zeros(len(h), np.int64)
        for a in range(0, len(h), cache.most):  # a run's words fit an empty cache; its ids are taken before the next may empty it
            run = slice(a, a + cache.most)
            slot = cache.find(h[run])
            if (slot < 0).any():
                new, first = _distinct(h[run], slot < 0)
                if cache.n + len(new) > cache.most:
                    cache.reset()
                    new, first = _distinct(h[run], np.ones(len(slot), bool))
                joined = joined if joined is not None else "".join(part)
                cache.add(new, [joined[i:j] for i, j in zip(start[a + first].tolist(), end[a + first].tolist(), strict=True)])
                slot = cache.find(h[run])
            begin, size[run] = cache.begin[slot], cache.begin[slot + 1] - cache.begin[slot]
            held = cache.holds(slot, cps, start[run], end[run])
            if held.all():
                upto = np.cumsum(size[run])
                parts.append(cache.pool[np.repeat(begin - (upto - size[run]), size[run]) + np.arange(upto[-1])])
                continue
            joined = joined if joined is not None else "".join(part)
            for i, k in enumerate(begin.tolist()):  # words whose hash another word has go to the model one by one
                own = cache.pool[k : k + size[a + i]] if held[i] else np.array(cache.ids(joined[start[a + i] : end[a + i]]), np.uint32)
                size[a + i] = len(own)
                parts.append(own)
        word_doc = np.searchsorted(offsets, start, "right") - 1
        sizes.append(np.bincount(word_doc, weights=size, minlength=len(part)).astype(np.int64))
    all_sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), np.concatenate([[0], np.cumsum(all_sizes)])


def _distinct(h: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of the marked places, and the first place of each."""
    at = np.flatnonzero(among)
    new, first = np.unique(h[at], return_index=True)
    return new, at[first]


def _encode_split(split: list[list[str]], path: str, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """encode() of texts split at added tokens: every second piece of each is one."""
    ids, offsets = encode([piece for pieces in split for piece in pieces[::2]], path)
    out, sizes, k = [], [], 0
    for pieces in split:
        own = []
        for i, piece in enumerate(pieces):
            if i % 2:
                own.append(np.array([known[piece]], np.uint32))
            else:
                own.append(ids[offsets[k] : offsets[k + 1]])
                k += 1
        out += own
        sizes.append(sum(map(len, own)))
    return np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)])
