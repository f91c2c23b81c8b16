"""Words of many texts at once in numpy: byte classes, word bounds and 64-bit hashes of words and of runs of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BYTES = np.arange(256)
#: A-Z to a-z; other bytes stay.
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 0x20, _BYTES).astype(np.uint8)
#: Bytes of the words [^\x20\x09-\x0D]+ and, after lower-casing, [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
NOT_BLANK = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
_ROOT = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.Generator(np.random.Philox(key=[1, 7])).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
#: Bytes that are hashed at once: arrays of eight bytes for each byte of text then stay in a cache, however long a text is.
_STEP = 1 << 16
_UP, _DOWN = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(_STEP - 1, np.uint64(b))])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of ``texts`` (UTF-8), lower-cased in A-Z: ``doc``, ``begin``, ``end`` (byte bounds in ``data``) and ``hash`` of each.

    ``first[i]`` is the number of the first word of text i, so its words are first[i] to first[i + 1].
    """

    def __init__(self, texts: list[bytes], members: np.ndarray):
        self.data = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.at = np.cumsum(sizes) - sizes
        inside = np.concatenate([[False], members[self.data], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.begin, self.end = edges[0::2], edges[1::2]
        self.first = np.concatenate([np.searchsorted(self.begin, self.at), [len(self.begin)]])
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hash = mixed(self._polynomials(edges) + _ROOT)

    def _polynomials(self, edges: np.ndarray) -> np.ndarray:
        """Of each word the sum of its bytes' values times powers of a base, from power 0 at its first byte on; by steps of _STEP bytes."""
        before, down = np.empty(len(edges), np.uint64), np.empty(len(edges), np.uint64)
        cuts = np.searchsorted(edges, np.arange(0, len(self.data) + _STEP, _STEP))
        so_far, up, back = 0, 1, 1  # sum of earlier steps, and the base's power at this one and its inverse, modulo 2 ** 64
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            values = _TABLE[self.data[k * _STEP : (k + 1) * _STEP]] * _UP[: len(self.data) - k * _STEP]
            sums = np.cumsum(values, dtype=np.uint64)
            at = edges[lo:hi] - k * _STEP
            before[lo:hi] = (sums[at] - values[at]) * np.uint64(up) + np.uint64(so_far)
            down[lo:hi] = _DOWN[at] * np.uint64(back)
            so_far = (so_far + up * int(sums[-1])) % (1 << 64)
            up, back = up * pow(_BASE, _STEP, 1 << 64) % (1 << 64), back * pow(_BASE, -_STEP, 1 << 64) % (1 << 64)
        return (before[1::2] - before[0::2]) * down[0::2]

    def runs(self, n: int) -> np.ndarray:
        """The hash of the ``n`` words from each word on; the last n - 1 words of all have none."""
        if len(self.hash) < n:
            return np.zeros(0, np.uint64)
        m = len(self.hash) - n + 1
        out = np.zeros(m, np.uint64)
        for i in range(n):
            out = mixed(out * np.uint64(3) + self.hash[i : i + m] + np.uint64(i))
        return out


def rounds(values, n_bytes: int = 500_000) -> Iterator[tuple[int, int, list[bytes]]]:
    """Cut a column of texts into runs (from, to, UTF-8 texts) of about ``n_bytes``; null is empty. A longer text is a run of its own."""
    held, size, begin = [], 0, 0
    for i, text in enumerate(values):
        raw = text.encode("utf-8", "replace") if isinstance(text, str) else b""
        if held and size + len(raw) > n_bytes:
            yield begin, i, held
            held, size, begin = [], 0, i
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield begin, begin + len(held), held
