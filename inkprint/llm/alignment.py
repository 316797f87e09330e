"""Edit distances within a band, by bit vectors of arbitrary width."""

from __future__ import annotations

from collections.abc import Hashable, Sequence


def places(pattern: Sequence[Hashable]) -> dict[Hashable, int]:
    """For each symbol the bit set of its places in the pattern."""
    found: dict[Hashable, int] = {}
    for i, symbol in enumerate(pattern):
        found[symbol] = found.get(symbol, 0) | (1 << i)
    return found


def banded_distance(a: Sequence[Hashable], b: Sequence[Hashable], budget: int) -> int | None:
    """Edits that turn ``a`` into ``b``, or None if more than ``budget`` are needed.

    Only the diagonals up to ``budget`` away from the main one are computed. One number
    holds the vertical differences of a column within the band, so that a column costs a
    few operations on numbers of ``2 * budget + 1`` bits. Bit t of column j stands for row
    ``j - budget + t``. Rows above the first are as if both sides had the same long prefix.
    """
    if abs(len(a) - len(b)) > budget:
        return None
    band = (1 << (2 * budget + 1)) - 1
    top = 1 << (2 * budget)
    falling = (1 << (budget + 1)) - 1
    rising = band ^ falling
    at = places(a)
    end = 1 << (len(a) - len(b) + budget)
    distance = abs(len(a) - len(b))
    shift = -budget
    for symbol in b:
        hits = at.get(symbol, 0)
        hits = ((hits >> shift) if shift >= 0 else (hits << -shift)) & band
        shift += 1
        rising = (rising >> 1) | top
        falling >>= 1
        level = ((((hits & rising) + rising) ^ rising) | hits | falling) & band
        right_up = falling | (band & ~(level | rising))
        right_down = level & rising
        if not level & end:
            distance += 1
            if distance > budget:
                return None
        right_up = ((right_up << 1) | 1) & band
        right_down = (right_down << 1) & band
        rising = right_down | (band & ~(level | right_up))
        falling = level & right_up
    return distance


def best_inside(at: dict[Hashable, int], length: int, region: Sequence[Hashable]) -> tuple[int, int]:
    """Fewest edits that turn the pattern into a part of the region, and where it ends.

    ``at`` are the ``places`` of the pattern. The region is the band: a run of text around
    a few diagonals. Among equals the first end counts.
    """
    full = (1 << length) - 1
    last = 1 << (length - 1)
    rising, falling = full, 0
    distance = best = length
    best_end = 0
    for end, symbol in enumerate(region, 1):
        hits = at.get(symbol, 0)
        level = (((hits & rising) + rising) ^ rising) | hits | falling
        right_up = falling | (full & ~(level | rising))
        right_down = level & rising
        if right_up & last:
            distance += 1
        elif right_down & last:
            distance -= 1
        if distance < best:
            best, best_end = distance, end
        right_up = (right_up << 1) & full
        right_down = (right_down << 1) & full
        rising = right_down | (full & ~(level | right_up))
        falling = level & right_up
    return best, best_end
