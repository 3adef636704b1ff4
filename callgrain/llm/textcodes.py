"""Words, bags and digests of many texts at once, over NumPy arrays of code points.

A word is a run of letters (with their vowel signs) or digits, without regard to case. Texts are taken whole; a
batch is cut into chunks of whole texts so that memory stays bounded by CHUNK code points or the longest text.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

CHUNK = 1_500_000
#: Word hashes keep 52 bits; the upper 12 hold a text's place in its chunk while a chunk is sorted.
WORD_BITS = np.uint64(52)
WORD_MASK = np.uint64((1 << 52) - 1)
MAX_TEXTS = 1 << 12

SEED_A, SEED_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BASE_A, BASE_B = np.uint64(0x100000001B3), np.uint64(0x5851F42D4C957F2D)


@lru_cache(maxsize=1)
def word_table() -> np.ndarray:
    """1 for code points that belong to words: letters, marks and numbers, but not variation selectors."""
    t = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] in "LMN":
            t[c] = 1
    t[0xFE00:0xFE10] = 0
    t[0xE0100:0xE01F0] = 0
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, 4096), base, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            _powers[int(base)] = have = np.cumprod(steps)
    return have


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(index of the first text, texts) with at most CHUNK code points, or one longer text."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if held and (size + len(t) > CHUNK or len(held) >= MAX_TEXTS):
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield first, held


@dataclass
class Words:
    """Words of a chunk: place of the text in the chunk, first and last+1 code point, 64-bit hash; codes of the chunk."""

    codes: np.ndarray
    bounds: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    n_docs: int


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts joined by line feeds, and where each text starts (and one past the last)."""
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)), out=bounds[1:])
    return codes, bounds


def words_of(texts: list[str], fold: bool = True) -> Words:
    """All words of a chunk of texts."""
    if fold:
        texts = [t.casefold() for t in texts]
    codes, bounds = codes_of(texts)
    inside = word_table()[codes]
    edge = np.flatnonzero(np.diff(inside)) + 1  # the last code point is a line feed, so runs end inside
    if inside[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    if len(start) == 0:
        none = np.zeros(0, np.int64)
        return Words(codes, bounds, none, none, none, np.zeros(0, np.uint64), len(texts))
    at = np.flatnonzero(inside)
    length = end - start
    offset = np.zeros(len(start), np.int64)
    np.cumsum(length[:-1], out=offset[1:])
    within = np.arange(len(at)) - np.repeat(offset, length)
    with np.errstate(over="ignore"):
        p = powers(BASE_A, int(length.max()) + 1)
        h = np.add.reduceat((codes[at].astype(np.uint64) + SEED_A) * p[within], offset)
        h = mix(h + length.astype(np.uint64) * SEED_B)
    doc = np.searchsorted(bounds, start, "right") - 1
    return Words(codes, bounds, doc, start, end, h, len(texts))


def firsts(sorted_ids: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], sorted_ids[1:] != sorted_ids[:-1]))) if len(sorted_ids) else np.zeros(0, np.int64)


@dataclass
class Bags:
    """Elements (word, how often it stood before in the text) of a chunk, by text, in order of word hash."""

    doc: np.ndarray
    element: np.ndarray
    size: np.ndarray
    key_a: np.ndarray
    key_b: np.ndarray


def bags_of(texts: list[str], words: Words | None = None) -> Bags:
    """The multiset of words of each text as a set of elements; key_a and key_b digest the whole multiset."""
    w = words or words_of(texts)
    size = np.bincount(w.doc, minlength=w.n_docs)
    key_a, key_b = np.zeros(w.n_docs, np.uint64), np.zeros(w.n_docs, np.uint64)
    if len(w.doc) == 0:
        return Bags(w.doc, w.hash, size, key_a, key_b)
    key = np.sort((w.doc.astype(np.uint64) << WORD_BITS) | (w.hash & WORD_MASK))
    doc = (key >> WORD_BITS).astype(np.int64)
    run = firsts(key)
    nth = np.arange(len(key)) - np.repeat(run, np.diff(np.append(run, len(key))))
    with np.errstate(over="ignore"):
        element = mix((key & WORD_MASK) + nth.astype(np.uint64) * SEED_A)
        at = firsts(doc)
        key_a[doc[at]] = np.add.reduceat(mix(element ^ SEED_A), at)
        key_b[doc[at]] = np.add.reduceat(mix(element ^ SEED_B), at)
    return Bags(doc, element, size, key_a, key_b)


def sequence_digests(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits, as two arrays, over each text's letters and digits in their order; 0 where it has none."""
    a, b = np.zeros(w.n_docs, np.uint64), np.zeros(w.n_docs, np.uint64)
    if len(w.start) == 0:
        return a, b
    at = np.flatnonzero(word_table()[w.codes])
    doc = np.searchsorted(w.bounds, at, "right") - 1
    run = firsts(doc)
    length = np.diff(np.append(run, len(at)))
    within = np.arange(len(at)) - np.repeat(run, length)
    c = w.codes[at].astype(np.uint64)
    with np.errstate(over="ignore"):
        n = length.astype(np.uint64)
        for out, base, seed in ((a, BASE_A, SEED_A), (b, BASE_B, SEED_B)):
            p = powers(base, int(length.max()) + 1)
            out[doc[run]] = mix(np.add.reduceat(mix(c + seed) * p[within], run) + n * seed) | np.uint64(1)
    return a, b
