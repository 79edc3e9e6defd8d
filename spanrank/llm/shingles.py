"""Hashed word shingles of UTF-8 text, vectorised over a batch of documents."""

from __future__ import annotations

import hashlib

import numpy as np

from .common import Poly, mix

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_POLY = Poly(20240611)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` (A-Z folded) and each document's first word index, len+1."""
    data = _FOLD[data]
    solid = ~_BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return _POLY.of(_POLY.prefix(data), start, end), np.searchsorted(start, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Each document's sorted distinct k-word shingle hashes; fewer words give one shingle, none give none."""
    words, at = word_hashes(data, offsets)
    n = max(0, len(words) - k + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled = mix(rolled * _STEP + words[j : j + n])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for w in words[a:b]:
                h = mix(h * _STEP + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_digest(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


class MinHash:
    """Minima of ``bands * rows`` universal hashes, and a 64-bit key for each band."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = bands * rows
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 1 << 31, n, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        self.salt = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def signature(self, items: np.ndarray) -> np.ndarray:
        x = (items >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 8192):
            h = self.a[:, None] * x[None, i : i + 8192]
            h += self.b[:, None]
            np.minimum(least, h.min(axis=1), out=least)
        return least

    def keys(self, signature: np.ndarray) -> np.ndarray:
        rows = signature.reshape(self.bands, self.rows).astype(np.uint64)
        h = self.salt.copy()
        for j in range(self.rows):
            h = mix(h * _STEP + rows[:, j])
        return h
