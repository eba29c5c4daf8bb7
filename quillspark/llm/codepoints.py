"""Texts as arrays of code points, and per-code-point tables made by rule."""

from __future__ import annotations

from functools import cache

import numpy as np


def codes(text: str) -> np.ndarray:
    """One uint32 per code point (lone surrogates included)."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@cache
def folded() -> np.ndarray:
    """By code point: its lower case where it is a letter or digit (one code point), else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalnum():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@cache
def letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]
