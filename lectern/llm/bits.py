"""Bit strings in numpy: pack codes of mixed widths, read codes at many bit positions at once."""

from __future__ import annotations

import numpy as np


def pack_at(n_bits: int, at: np.ndarray, values: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Bytes of ``n_bits`` bits, big-endian, with ``values`` of ``widths`` (0 to 32) at bit positions ``at``.

    The codes may not overlap; bits that none covers are 0.
    """
    words = np.zeros(n_bits // 32 + 2, np.uint32)
    if len(at):
        spot = (at >> 5).astype(np.intp)
        moved = values.astype(np.uint64) << (64 - (at & 31) - widths).astype(np.uint64)
        np.add.at(words, spot, (moved >> np.uint64(32)).astype(np.uint32))
        np.add.at(words, spot + 1, moved.astype(np.uint32))
    return words.astype(">u4").view(np.uint8)[: (n_bits + 7) // 8]


def windows(data: np.ndarray) -> np.ndarray:
    """For each byte offset of ``data`` (and a few beyond) the 64 bits that start there; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    n = len(padded) - 8
    out = np.zeros(n, np.uint64)
    for i in range(8):
        out |= padded[i : i + n].astype(np.uint64) << np.uint64(56 - 8 * i)
    return out


def peek(wins: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bits from positions ``at`` on, left-aligned in 64; the upper 57 are valid. Positions past the end read zeros."""
    return wins[np.minimum(at >> 3, len(wins) - 1)] << (at & 7).astype(np.uint64)
