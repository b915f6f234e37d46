r"""Words of whole texts as 64-bit hashes, a batch of texts at a time in numpy.

A word is a run of `[^\x20\x09-\x0D]+`; A-Z count as a-z. Hashes depend on the word's bytes alone, so they agree
between tasks, runs and machines.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x5851F42D4C957F2D)
_PAGE = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= _M1
        x ^= x >> np.uint64(27)
        x *= _M2
        x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_BYTE[65:91] = _BYTE[97:123]
_POW = _powers(_BASE, _PAGE)
_POW_PAGE = _powers(np.uint64(pow(int(_BASE), _PAGE, 1 << 64)), 1 << 12)


@dataclass
class Words:
    """hash: of each word; first: index of each text's first word, with the number of words at the end; data, start, end: the words' bytes."""

    hash: np.ndarray
    first: np.ndarray
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes in one array, and where each begins (with the end at last); null counts as empty."""
    flat = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = flat.buffers()
    at = np.frombuffer(offsets, np.int64)[flat.offset : flat.offset + len(flat) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def split_words(texts: pa.Array) -> Words:
    raw, at = text_bytes(texts)
    solid = ~_SPACE[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = at[1:-1]
    inner = inner[inner < len(raw)]
    begins[inner] = solid[inner]
    start = np.flatnonzero(begins)
    first = np.searchsorted(start, at)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), first, raw, none, none)
    packed = np.flatnonzero(solid)
    at_packed = np.searchsorted(packed, start)
    length = np.diff(np.append(at_packed, len(packed)))
    place = np.arange(len(packed)) - np.repeat(at_packed, length)
    with np.errstate(over="ignore"):
        value = _BYTE[raw[packed]]
        value *= _POW[place & (_PAGE - 1)]
        if length.max() > _PAGE:
            value *= _POW_PAGE[(place >> 16) & 4095]
        sums = np.add.reduceat(value, at_packed)
        sums += length.astype(np.uint64) * _STEP
    return Words(mix(sums), first, raw, start, packed[at_packed + length - 1] + 1)


def sequence_hash(words: Words, seed: int) -> np.ndarray:
    """A 64-bit hash of each text's whole word sequence."""
    n, count = len(words.hash), words.count
    out = np.zeros(len(count), np.uint64)
    with np.errstate(over="ignore"):
        place = np.arange(n) - np.repeat(words.first[:-1], count)
        value = mix(words.hash + mix(place.astype(np.uint64) * _STEP + np.uint64(seed)))
        full = count > 0
        if n:
            out[full] = np.add.reduceat(value, words.first[:-1][full])
        return mix(out + count.astype(np.uint64) * _M1)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles of size words, sorted, in one array; and where each text's begin (with the end at last).

    A text of fewer words has its whole sequence as its one shingle; a text without words has none.
    """
    n, count = len(words.hash), words.count
    number = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(number)])
    out = np.empty(first[-1], np.uint64)
    if n:
        with np.errstate(over="ignore"):
            if n >= size:
                whole = np.zeros(n - size + 1, np.uint64)
                for k in range(size):
                    whole += mix(words.hash[k : n - size + 1 + k] + np.uint64(k + 1) * _STEP)
                whole = mix(whole)
        long = count >= size
        for i in np.flatnonzero(long):
            a, b = words.first[i], first[i]
            out[b : first[i + 1]] = whole[a : a + number[i]]
        short = np.flatnonzero(~long & (count > 0))
        if len(short):
            out[first[short]] = sequence_hash(words, size)[short]
    for i in np.flatnonzero(number > 1):
        out[first[i] : first[i + 1]].sort()
    new = np.ones(len(out), bool)
    if len(out):
        new[1:] = out[1:] != out[:-1]
        new[first[:-1][number > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[first]
