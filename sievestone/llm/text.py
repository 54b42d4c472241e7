"""Texts as arrays of code points, handled some hundred thousand at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Code points that are worked on at once; bounds the memory of a task whatever the length of a text.
CHUNK = 1 << 17

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """letter_table()[c]: whether code point c is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def give_back() -> None:
    """Return freed memory to the system at the end of a partition: a worker process lives on, idle, while later stages run."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place of h."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def gram_streams(texts: Iterable[str | None], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(stream, starts, docs): lower-cased code points, everything but letters as 0, in chunks.

    A document's stream is 0, its code points, then longest-1 zeros; each n-gram up to longest that
    starts in it is found in exactly one chunk. docs holds the index of the text and starts the first
    position of each of its pieces; a piece has longest-1 positions at its end where no n-gram counts.
    """
    letters, tail = letter_table(), np.zeros(longest - 1, np.uint32)
    parts: list[np.ndarray] = []
    starts: list[int] = []
    docs: list[int] = []
    total = 0
    for i, text in enumerate(texts):
        low = (text or "").lower()
        for a in range(0, len(low) + 1, CHUNK):
            b = min(a + CHUNK, len(low) + 1)
            piece = code_points(low[max(a - 1, 0) : b + longest - 2])
            piece = np.where(letters[piece], piece, np.uint32(0))
            if a == 0:
                piece = np.concatenate([tail[:1], piece])
            short = b - a + longest - 1 - len(piece)
            if short > 0:
                piece = np.concatenate([piece, tail[:short]])
            starts.append(total)
            docs.append(i)
            parts.append(piece)
            total += len(piece)
            if total >= CHUNK:
                yield np.concatenate(parts), np.array(starts + [total]), np.array(docs)
                parts, starts, docs, total = [], [], [], 0
    if parts:
        yield np.concatenate(parts), np.array(starts + [total]), np.array(docs)


def grams(stream: np.ndarray, starts: np.ndarray, n: int, longest: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, buckets) of the n-grams whose inner code points are letters and that hold a letter."""
    size = len(stream) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    good = np.ones(size, bool)
    if n == 1:
        good = stream != 0
    elif n == 2:
        good = (stream[:size] | stream[1 : 1 + size]) != 0
    for k in range(1, n - 1):
        good &= stream[k : k + size] != 0
    for k in range(longest - 1):  # the ends of the pieces: counted in the next piece, or past the text
        ends = starts[1:] - 1 - k
        good[ends[ends < size]] = False
    at = np.flatnonzero(good)
    h = np.full(len(at), n, np.uint64)
    for k in range(n):
        h *= np.uint64(0x100000001B3)
        h += stream[at + k]
    return at, (mix(h) >> np.uint64(64 - bits)).astype(np.int64)
