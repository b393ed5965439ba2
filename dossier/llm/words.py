"""Words of texts: runs of characters other than space and U+0009 to U+000D.

Column versions stay in the JVM. The numpy versions work on many texts at once: the texts of a slab are laid out in
one byte buffer, and every step (word borders, hashes, shingles) is a vector operation over the buffer.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SLAB_BYTES = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_blank = np.zeros(256, bool)
_blank[[9, 10, 11, 12, 13, 32]] = True


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, SLAB_BYTES + 1)
            steps = np.full(n, BASE, np.uint64)
            steps[0] = 1
            self.up = np.cumprod(steps, dtype=np.uint64)
            steps[1:] = INVERSE
            self.down = np.cumprod(steps, dtype=np.uint64)


POWERS = Powers()


def prefix_hash(buffer: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`span_hash` takes the hash of any span of the buffer."""
    POWERS.need(len(buffer) + 1)
    out = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * POWERS.up[: len(buffer)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * POWERS.down[start] + (end - start).astype(np.uint64))


def encoded(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def slabs(texts: Sequence, limit: int = SLAB_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, encoded texts) in runs of about ``limit`` bytes; one longer text is a run of its own."""
    first, size, held = 0, 0, []
    for i, text in enumerate(texts):
        data = encoded(text)
        if held and size + len(data) > limit:
            yield first, held
            first, size, held = i, 0, []
        held.append(data)
        size += len(data) + 1
    if held:
        yield first, held


def word_hashes(texts: list[bytes], first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, border positions: words of text i are ``[border[i], border[i + 1])``).

    ``first``: hash that many leading bytes of each word only.
    """
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    gap = _blank[buffer]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    border = np.concatenate(([0], np.searchsorted(start, ends)))
    if first is not None:
        end = np.minimum(end, start + first)
    return span_hash(prefix_hash(buffer), start, end), border


def shingles(hashes: np.ndarray, border: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word runs, and their borders. A shorter text with words has one run, of all its words."""
    count = np.diff(border)
    kept = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    out_border = np.concatenate(([0], np.cumsum(kept)))
    first = np.repeat(border[:-1] - out_border[:-1], kept) + np.arange(out_border[-1])
    padded = np.concatenate((hashes, np.zeros(size, np.uint64)))
    last = np.repeat(border[1:], kept)
    out = np.zeros(len(first), np.uint64)
    short = len(count) and bool((count < size).any())
    for k in range(size):
        word = padded[first + k]
        if short:
            word = np.where(first + k < last, word, np.uint64(0))
        out = mix(out * BASE + word + np.uint64(1)) if k == size - 1 else out * BASE + word + np.uint64(1)
    return out, out_border
