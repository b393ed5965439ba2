"""Winnowed fingerprints of texts: hashes of character windows, the least of each neighbourhood kept."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
WORD = 1 << 64

#: Least length of a passage -> (characters of a window, windows of a neighbourhood). A passage of that length holds a
#: whole neighbourhood. Shorter passages are windows of their own length, all of which are kept.
LEVELS = {63: (32, 32), 15: (8, 8)}


def level_of(length: int) -> int:
    return next((least for least in LEVELS if length >= least), length)


def spread_bits(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(text: str, width: int) -> np.ndarray:
    """A hash of every ``width`` characters in a row, put together from windows of one, two, four ... characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    count = len(codes) - width + 1
    if count < 1:
        return np.zeros(0, np.uint64)
    done, total, size, piece = 0, np.zeros(count, np.uint64), 1, codes
    while True:
        if width & size:
            total = total * np.uint64(pow(BASE, size, WORD)) + piece[done : done + count]
            done += size
        if done == width:
            return spread_bits(total)
        piece = piece[:-size] * np.uint64(pow(BASE, size, WORD)) + piece[size:]
        size *= 2


def winnowed(hashes: np.ndarray, among: int) -> np.ndarray:
    """Places of the least hash (the first of equal ones) of every ``among`` neighbours."""
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    if len(least) < among:
        return np.zeros(0, np.int64)
    size = 1
    while 2 * size <= among:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < among:
        least = np.minimum(least[: size - among], least[among - size :])
    return np.unique(least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def fingerprints(text: str, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places of their windows). Two texts that share a passage of the level share one of its prints."""
    width, among = LEVELS.get(level, (level, 1))
    hashes = window_hashes(text, width)
    places = winnowed(hashes, among) if among > 1 else np.arange(len(hashes))
    return hashes[places].view(np.int64), places
