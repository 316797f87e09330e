"""Words of many texts at once, as arrays over one buffer of bytes.

Words are runs of anything but ASCII white space. The buffer holds every word followed by one
space, so the bytes of consecutive words of a text are one slice.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from inkprint.llm.common import mixed

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\v\f\r")] = True
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
PIECE_BYTES = 1 << 19


class _Powers:
    """Powers of the base of the hash and of its inverse, as far as they were needed."""

    up = np.zeros(0, np.uint64)
    down = np.zeros(0, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = cls._of(_BASE, n), cls._of(_INVERSE, n)
        return cls.up[:n], cls.down

    @staticmethod
    def _of(base: int, n: int) -> np.ndarray:
        factors = np.full(n, base, np.uint64)
        factors[:1] = 1
        return np.cumprod(factors, dtype=np.uint64)


class Words:
    """``buffer`` and, for each word, ``start``, ``end`` and a 64-bit ``hashes`` of its bytes.

    ``count`` is the number of words of each text.
    """

    def __init__(self, texts: Sequence[bytes]):
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        space = _SPACE[raw]
        before = np.ones(len(raw), bool)
        before[1:] = space[:-1]
        ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
        begins = np.flatnonzero(~space & before)
        self.count = np.diff(np.searchsorted(begins, ends), prepend=0)
        keep = ~(space & before)
        self.buffer = raw[keep]
        gaps = space[keep]
        self.buffer[gaps] = 32
        self.end = np.flatnonzero(gaps)
        self.start = np.empty_like(self.end)
        if len(self.end):
            self.start[0] = 0
            self.start[1:] = self.end[:-1] + 1
        self.bytes = self.buffer.tobytes()
        self.hashes = self._hashed()

    def _hashed(self) -> np.ndarray:
        out = np.empty(len(self.end), np.uint64)
        first = 0
        while first < len(self.end):
            origin = self.start[first]
            last = max(first + 1, int(np.searchsorted(self.end, origin + PIECE_BYTES, "right")))
            begin, end = self.start[first:last] - origin, self.end[first:last] - origin
            up, down = _Powers.upto(int(end[-1]))
            total = np.zeros(int(end[-1]) + 1, np.uint64)
            np.cumsum(_VALUE[self.buffer[origin : origin + end[-1]]] * up, out=total[1:])
            out[first:last] = (total[end] - total[begin]) * down[begin]
            first = last
        return mixed(out)

    def text(self, first: int, last: int) -> bytes:
        """The words from ``first`` up to ``last``, joined by one space."""
        return self.bytes[self.start[first] : self.end[last - 1]] if last > first else b""

    def same(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Whether the ``length`` words from each of ``a`` have the bytes of those from ``b``."""
        low_a, low_b = self.start[a], self.start[b]
        size = self.end[a + length - 1] - low_a
        equal = size == self.end[b + length - 1] - low_b
        upto = np.cumsum(size)
        first = 0
        while first < len(a):
            done = upto[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(upto, done + PIECE_BYTES, "right")))
            n = size[first:last]
            begin = upto[first:last] - n - done
            at = np.arange(upto[last - 1] - done)
            one = self.buffer[at + np.repeat(low_a[first:last] - begin, n)]
            # A shorter partner near the end of the buffer is unequal already.
            other = np.minimum(at + np.repeat(low_b[first:last] - begin, n), len(self.buffer) - 1)
            equal[first:last] &= ~np.logical_or.reduceat(one != self.buffer[other], begin)
            first = last
        return equal
