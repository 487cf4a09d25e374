"""Hashed word shingles of whole texts, as sorted arrays of distinct 64-bit numbers."""

from __future__ import annotations

import numpy as np
import xxhash

from .frames import kept

# Entries of a worker's table of hashed words; a full table is emptied, which changes no result.
KNOWN = 50_000

# Odd multipliers of the places in a shingle.
PLACES = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], dtype=np.uint64
)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8: what bytes.split and bytes.lower do."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (the finaliser of MurmurHash3)."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    known = kept(("words",), dict)
    try:
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(known) > KNOWN:
            known.clear()
        # Not a set difference with the keys: that walks the whole table.
        for word in set(words):
            if word not in known:
                known[word] = xxhash.xxh3_64_intdigest(word)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """One number per run of ``width`` words, in order of place."""
    count = len(hashes) - width + 1
    total = np.zeros(count, np.uint64)
    for place in range(width):
        total += hashes[place : place + count] * PLACES[place % len(PLACES)] + np.uint64(place)
    return mixed(total + np.uint64(width))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingles; with fewer words than ``width`` the whole sequence as one, without words none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    return np.unique(rolled(hashes, min(width, len(words))))
