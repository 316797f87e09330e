"""Sparse matrices in compressed rows, and their products row by row."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Products that are held at once; a row with more of them is worked on alone.
PRODUCTS = 1 << 21


@dataclass(frozen=True)
class Csr:
    """Row i has the columns ``indices[starts[i]:starts[i + 1]]`` with the numbers ``data`` there."""

    starts: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    width: int

    @staticmethod
    def of(rows: np.ndarray, columns: np.ndarray, data: np.ndarray, height: int, width: int) -> Csr:
        """A matrix of entries in any order; entries at one place are added up."""
        places, inverse = np.unique(rows * width + columns, return_inverse=True)
        total = np.zeros(len(places), np.int64)
        np.add.at(total, inverse, data)
        starts = np.searchsorted(places, np.arange(height + 1) * width)
        return Csr(starts, places % width, total, width)

    @property
    def height(self) -> int:
        return len(self.starts) - 1

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(self.height), np.diff(self.starts))

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        counts = np.bincount(self.indices, minlength=self.width)
        starts = np.concatenate([[0], np.cumsum(counts)])
        return Csr(starts, self.rows()[order], self.data[order], self.height)


def _row_blocks(work: np.ndarray, bound: int) -> Iterator[tuple[int, int]]:
    upto, first = np.cumsum(work), 0
    while first < len(work):
        done = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, done + bound, "right")))
        yield first, last
        first = last


def product(a: Csr, b: Csr, bound: int = PRODUCTS) -> Csr:
    """The product of two matrices, by rows of ``b`` that each row of ``a`` adds up (Gustavson).

    Rows of ``a`` are taken in blocks of about ``bound`` products.
    """
    lengths = np.diff(b.starts)[a.indices]
    before = np.concatenate([[0], np.cumsum(lengths)])
    counts, columns, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first, last in _row_blocks(np.diff(before[a.starts]), bound):
        low, high = a.starts[first], a.starts[last]
        width = lengths[low:high]
        row = np.repeat(np.repeat(np.arange(last - first), np.diff(a.starts[first : last + 1])), width)
        at = np.arange(len(row)) + np.repeat(b.starts[a.indices[low:high]] - (before[low:high] - before[low]), width)
        added = Csr.of(row, b.indices[at], np.repeat(a.data[low:high], width) * b.data[at], last - first, b.width)
        counts.append(np.diff(added.starts))
        columns.append(added.indices)
        numbers.append(added.data)
    starts = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    return Csr(starts, np.concatenate(columns), np.concatenate(numbers), b.width)
