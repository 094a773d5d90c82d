"""Hashed character n-grams of many texts at once, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Characters of a text that are looked at together; longer texts are taken piece by piece.
PIECE_CHARS = 1_000_000
_MULTIPLIER = np.uint32(0x9E3779B1)
_STEP = np.uint32(0x01000193)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each text's stretch starts (and the end).

    Two line ends stand before the first text and after each, so that no n-gram of three
    characters or fewer reaches from one text into another.
    """
    joined = "\n\n".join(["", *texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.full(len(texts) + 1, 2, np.int64)
    starts[1:] += np.cumsum([len(t) + 2 for t in texts], dtype=np.int64)
    return points, starts


def ngrams(points: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that ends at each place (those at the first n - 1 places reach outside and hold less)."""
    h = points * _MULTIPLIER
    mixed = h.copy()
    for k in range(1, n):
        mixed[k:] = (mixed[k:] ^ (h[:-k] * np.uint32(2 * k + 1))) * _STEP
    mixed += np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return (mixed >> np.uint32(32 - bits)).astype(np.int32)


def in_pieces(texts: list[str], chars: int = PIECE_CHARS) -> Iterator[tuple[list[int], list[str]]]:
    """The texts, with their numbers, in groups of about chars characters at most; a longer text in several pieces."""
    numbers: list[int] = []
    held: list[str] = []
    size = 0
    for n, text in enumerate(texts):
        for start in range(0, max(1, len(text)), chars):
            piece = text[start : start + chars]
            if held and size + len(piece) > chars:
                yield numbers, held
                numbers, held, size = [], [], 0
            numbers.append(n)
            held.append(piece)
            size += len(piece) + 1
    if held:
        yield numbers, held


def sums_by_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of the values in each text's stretch (every stretch has one value at least)."""
    return np.add.reduceat(values, starts[:-1], axis=0)
