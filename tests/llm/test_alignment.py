from hypothesis import given
from hypothesis import strategies as st

from inkprint.llm.alignment import banded_distance, best_inside, places

SYMBOLS = st.lists(st.integers(0, 2), max_size=14)


def table(a, b, free_start):
    rows = [[0 if free_start else j for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
        rows.append(row)
    return rows[-1]


@given(SYMBOLS, SYMBOLS, st.integers(0, 8))
def test_banded_distance(a, b, budget):
    distance = table(a, b, False)[-1]
    assert banded_distance(a, b, budget) == (distance if distance <= budget else None)


@given(SYMBOLS.filter(bool), SYMBOLS)
def test_best_inside(a, b):
    last = table(a, b, True)
    assert best_inside(places(a), len(a), b) == (min(last), last.index(min(last)))
